"""Text scoring: thirteen 0–5 features, penalties, weighted dimensions and a citation outlook."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citegrain.functions import markdown as M
from citegrain.functions.text import any_term, compact, keyword_tokens, let, terms_present, text_or_empty
from citegrain.operators.frames import steps

# Fixed values and patterns.
WORDS = r"[A-Za-z0-9\x{4e00}-\x{9fa5}\x{3041}-\x{3093}\x{30a1}-\x{30f3}\x{30fc}]+"
NOISE_TERMS = ("cookie consent", "adobeorg", "utm_", "#container", "accept all cookies", "reject all")
RECENT = r"(?iu)202[5-9]|2026|令和[7-9]|last updated|updated|valid until|更新日|掲載日|有効期限"
OLDER = r"202[3-4]|令和[5-6]"
SCHEMA_NAMES = r"(?i)(?:FAQPage|Product|Offer|OfferCatalog|Organization|WebPage|BreadcrumbList|Vehicle|Review|AggregateRating)"
# What a text with a schema name holds in lower case.
SCHEMA_TERMS = ("faqpage", "product", "offer", "organization", "webpage", "breadcrumblist", "vehicle", "review", "aggregaterating")
FEATURES = (
    "answer_first", "query_relevance", "extractable_passages", "specific_facts", "statistics",
    "source_citations", "comparison_readiness", "faq_readiness", "schema", "freshness", "neutral_tone",
    "authority_signals", "accessibility",
)
PENALTIES = ("promotional_language_penalty", "noise_penalty", "keyword_stuffing")
DIMENSION_MAX = 20
PROMOTION_DIMENSIONS = ("content_clarity", "eeat_signals")
NOISE_DIMENSIONS = ("content_clarity", "freshness_index")

DEFAULTS = {
    "answer_first_max_chars": 1200, "max_questions": None, "min_word_count_basic": 300,
    "min_word_count_strong": 900, "statistics_min_numeric_mentions": 5, "faq_min_questions": 3,
    "comparison_terms": (), "citation_terms": (), "authority_terms": (), "promotional_terms": (),
}

# An own weighting of the features into the six dimensions; callers may pass another.
EXAMPLE_DIMENSIONS = {
    "content_clarity": {"answer_first": 2, "extractable_passages": 2, "neutral_tone": 1},
    "semantic_depth": {"query_relevance": 2, "specific_facts": 2, "statistics": 1},
    "structured_data": {"schema": 3, "accessibility": 1},
    "eeat_signals": {"source_citations": 2, "authority_signals": 2},
    "freshness_index": {"freshness": 1},
    "faq_readiness": {"faq_readiness": 2, "comparison_readiness": 1},
}


def _recent(text: Column, low: Column) -> Column:
    """``RECENT`` without an alternation of words at every position; "updated" covers "last updated"."""
    words = any_term(text, ("更新日", "掲載日", "有効期限")) | F.contains(low, F.lit("updated"))
    return words | text.rlike("202[5-9]|令和[7-9]") | (F.contains(low, F.lit("val")) & text.rlike("(?iu)valid until"))


def text_scores(
    markdown, query=None, page_url=None, page_type=None, signals: Column | None = None,
    metrics: Column | None = None, dimensions: dict | None = None, heuristics: dict | None = None,
    footer_chars: Column | None = None, likely_from: int = 90, occasional_from: int = 60,
    feature_weights: dict | None = None, penalty_weights: dict | None = None, full_markdown_chars: Column | None = None,
    metadata_schema_types: Column | None = None, visible_dates: Column | None = None,
) -> Column:
    """Struct of features, penalties, dimension scores and totals for one text.

    Weights and term lists are configuration, so they become constants of the expression
    and the score needs neither a join nor a shuffle. A dimension is a dict of feature weights, or a dict of
    ``feature_weights`` and ``max``, its highest score (20 if not given). Without ``dimensions`` the features weigh
    ``feature_weights`` (1 where not given) and the penalties, times ``penalty_weights`` (0 where not given), are taken
    off. ``signals`` and ``metrics`` are optional structs of the page's manifest; ``full_markdown_chars`` is the size of
    the whole page, ``metadata_schema_types`` the types its metadata names, ``visible_dates`` the dates it shows.
    """
    h = {**DEFAULTS, **(heuristics or {})}
    blank = F.lit("")
    raw = text_or_empty(markdown)
    value = lambda struct, name, default: F.coalesce(struct[name], F.lit(default)) if struct is not None else F.lit(default)
    sig = lambda name: value(signals, name, False)
    met = lambda name: value(metrics, name, 0)
    listed = lambda c: F.lit(False) if c is None else F.coalesce(F.size(c) > 0, F.lit(False))

    def measure(both: Column) -> Column:
        text, low = both["text"], both["low"]
        q_tokens = F.array_distinct(keyword_tokens(query if query is not None else blank))
        # query tokens hold no stop words, so the text tokens need no filter before intersecting
        t_tokens = F.regexp_extract_all(
            F.concat_ws(" ", low, *[F.lower(text_or_empty(c)) for c in (page_url, page_type) if c is not None]),
            F.lit(WORDS), F.lit(0),
        )
        first_block = F.left(low, F.lit(h["answer_first_max_chars"]))
        headings = F.filter(
            F.transform(M.all_of(text, r"(?md)^#{1,4}\s+(.+)$", 1), compact), lambda x: F.length(x) > 2
        )
        return F.struct(
            F.length(text).alias("chars"),
            F.regexp_count(text, F.lit(WORDS)).alias("words"),
            F.size(headings).alias("headings"),
            F.size(F.array_intersect(q_tokens, t_tokens)).alias("overlap"),
            F.size(q_tokens).alias("q_size"),
            ((F.length(first_block) > 250) & F.exists(q_tokens, lambda t: F.contains(first_block, t))).alias("early_hit"),
            F.size(M.real_questions(text, h["max_questions"])).alias("questions"),
            F.size(M.numeric_mentions(text)).alias("numbers"),
            ((M.table_line_count(text) >= 3) | F.contains(low, F.lit("<table"))).alias("tables"),
            terms_present(text, h["citation_terms"]).alias("citations"),
            terms_present(text, h["authority_terms"]).alias("authority"),
            terms_present(text, h["comparison_terms"]).alias("comparison"),
            terms_present(text, h["promotional_terms"]).alias("promotion"),
            _recent(text, low).alias("recent"),
            text.rlike(OLDER).alias("older"),
            F.contains(low, F.lit("robots.txt")).alias("robots_txt_mentioned"),
            F.contains(low, F.lit("llms.txt")).alias("llms_txt_mentioned"),
        )

    def evaluate(m: Column) -> Column:
        at_least = lambda c, test, n: F.when(test, F.greatest(c, F.lit(n))).otherwise(c)
        numbers = F.greatest(m["numbers"], met("numeric_fact_count"))
        bullets = met("bullet_count")
        citations = at_least(m["citations"], sig("source_citations"), 3)
        authority = at_least(m["authority"], sig("authority_signals") | sig("pdf_or_spec_links"), 3)
        comparison = at_least(m["comparison"], sig("comparison_terms") | (bullets >= 3), 3)
        questions = F.when((m["questions"] == 0) & (sig("faq_like") | sig("faq_schema")), 1).otherwise(m["questions"])
        noise = terms_present(raw, NOISE_TERMS)
        noise = F.when(sig("low_noise_ratio"), F.least(noise, F.lit(1))).otherwise(noise)
        raw_low = F.lower(raw)
        schema = (
            any_term(raw_low, ("application/ld+json", "schema.org"))
            | sig("schema_json_ld") | listed(signals["schema_types"] if signals is not None else None) | listed(metadata_schema_types)
        )
        overlap = m["overlap"]
        ratio = overlap / F.greatest(F.lit(1), F.least(m["q_size"], F.lit(12)))
        direct = ((overlap >= 2) & m["early_hit"]) | sig("answer_first")
        dates = listed(visible_dates)
        dated = sig("freshness_signals") | dates | (F.coalesce(footer_chars, F.lit(0)) > 150 if footer_chars is not None else F.lit(False))
        md_chars = met("markdown_chars")
        if full_markdown_chars is not None:
            # the whole page's size does not count for the lowest step
            whole = F.coalesce(full_markdown_chars, F.lit(0))
            md_chars = F.greatest(md_chars, F.when(whole >= 2500, whole).otherwise(0))
        passages = (
            (m["headings"] >= 2).cast("int") + (m["words"] >= h["min_word_count_basic"]).cast("int")
            + (m["words"] >= h["min_word_count_strong"]).cast("int") + (m["questions"] >= 2).cast("int")
            + m["tables"].cast("int")
        )
        features = {
            "answer_first": F.when(direct & (numbers >= 2), 5).when(direct, 3).when(overlap > 0, 1).otherwise(0),
            "query_relevance": F.when(ratio >= 0.55, 5).when(ratio >= 0.38, 4).when(ratio >= 0.25, 3)
                .when(overlap >= 2, 2).when(overlap > 0, 1).otherwise(0),
            "extractable_passages": F.greatest(passages, F.when(sig("extractable_passages"), 5)
                .when((met("heading_count") >= 4) & (met("unique_line_count") >= 20), 4).otherwise(0)),
            "specific_facts": F.when((numbers >= 8) & (overlap >= 2), 5).when((numbers >= 5) & (overlap >= 1), 4)
                .when(numbers >= 3, 3).when(numbers > 0, 1).otherwise(0),
            "statistics": steps(numbers, (10, 5), (7, 4), (h["statistics_min_numeric_mentions"], 3), (1, 1)),
            "source_citations": F.when((citations >= 4) & (authority >= 2), 5)
                .when((citations >= 3) | (met("link_count") >= 5), 4)
                .when((citations >= 1) | (met("link_count") >= 2), 2).otherwise(0),
            "comparison_readiness": F.when((comparison >= 4) & (m["tables"] | (bullets >= 5)), 5)
                .when(comparison >= 4, 4).when((comparison >= 2) | m["tables"] | (bullets >= 3), 3)
                .when(comparison > 0, 1).otherwise(0),
            "faq_readiness": steps(questions, (5, 5), (h["faq_min_questions"], 4), (1, 2)),
            "schema": F.when(schema, 5).when(sig("canonical") & sig("meta_description"), 4).otherwise(0),
            "freshness": F.when(dated | m["recent"], 4).when(m["older"], 2).otherwise(0),
            "neutral_tone": F.lit(5) - F.least(F.lit(5), m["promotion"]),
            "authority_signals": F.when((authority >= 5) | (met("pdf_link_count") >= 1), 5)
                .when((authority >= 3) | sig("authority_signals"), 4).when(authority >= 1, 2).otherwise(0),
            "accessibility": F.when((m["words"] >= 1000) | (md_chars >= 5000), 5)
                .when((m["words"] >= 600) | (md_chars >= 2500), 4)
                .when((m["words"] >= 300) | (md_chars >= 1200), 3)
                .when((m["words"] >= 80) | (md_chars >= 600), 1).otherwise(0),
        }
        return F.struct(
            F.struct(*[features[f].cast("int").alias(f) for f in FEATURES]).alias("features"),
            F.struct(
                F.least(F.lit(5), m["promotion"]).alias("promotional_language_penalty"),
                F.least(F.lit(5), F.floor(noise / 3).cast("int")).alias("noise_penalty"),
                F.lit(0).alias("keyword_stuffing"),
            ).alias("penalties"),
            m["words"].alias("word_count"),
            m["chars"].alias("cleaned_text_chars"),
            F.when(any_term(raw_low, SCHEMA_TERMS), F.array_distinct(F.regexp_extract_all(raw, F.lit(SCHEMA_NAMES), F.lit(0))))
            .otherwise(F.array().cast("array<string>")).alias("schema_types"),
            m["robots_txt_mentioned"].alias("robots_txt_mentioned"),
            m["llms_txt_mentioned"].alias("llms_txt_mentioned"),
        )

    def finish(r: Column) -> Column:
        f, p = r["features"], r["penalties"]
        if dimensions:
            scores = []
            for name, spec in dimensions.items():
                weights, most = spec.get("feature_weights", spec), int(spec.get("max", DIMENSION_MAX))
                whole = sum(float(w) for w in weights.values()) or 1.0
                weighted = sum((f[k] / 5.0 * float(w) for k, w in weights.items() if k in FEATURES), F.lit(0.0)) / whole
                points = F.bround(weighted * most).cast("int")
                if name in PROMOTION_DIMENSIONS:
                    points = points - F.least(F.lit(3), p["promotional_language_penalty"])
                if name in NOISE_DIMENSIONS:
                    points = points - F.least(F.lit(3), p["noise_penalty"])
                scores.append(F.struct(F.lit(name).alias("dimension"), F.greatest(F.lit(0), F.least(F.lit(most), points)).alias("score"), F.lit(most).alias("max")))
            scored = F.transform(F.array(*scores), lambda s: F.struct(
                s["dimension"].alias("dimension"), s["score"].alias("score"), band(s["score"]).alias("band"), s["max"].alias("max")
            ))
            geo = F.aggregate(scored, F.lit(0), lambda acc, s: acc + s["score"])
            hundred = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(geo / 1.2).cast("int")))
        else:
            scored = F.array().cast("array<struct<dimension:string,score:int,band:string,max:int>>")
            weight = {k: float((feature_weights or {}).get(k, 1.0)) for k in FEATURES}
            best = 5 * sum(weight.values())
            weighted = sum((f[k] * w for k, w in weight.items()), F.lit(0.0))
            off = sum((p[k] * float(w) for k, w in (penalty_weights or {}).items() if k in PENALTIES), F.lit(0.0))
            share = F.bround((weighted - off) / best * 100).cast("int") if best else F.lit(0)
            hundred = F.greatest(F.lit(0), F.least(F.lit(100), share))
            geo = F.bround(hundred * 1.2).cast("int")
        return let(
            F.struct(hundred.alias("score"), geo.alias("geo_score_120"), scored.alias("dimension_scores")),
            lambda s: F.struct(
                s["score"].alias("score"),
                s["geo_score_120"].alias("geo_score_120"),
                F.when(s["geo_score_120"] >= likely_from, "likely cited")
                .when(s["geo_score_120"] >= occasional_from, "occasionally cited")
                .otherwise("rarely cited").alias("citation_likelihood"),
                s["dimension_scores"].alias("dimension_scores"),
                f.alias("features"), p.alias("penalties"), r["word_count"].alias("word_count"),
                r["cleaned_text_chars"].alias("cleaned_text_chars"), r["schema_types"].alias("schema_types"),
                r["robots_txt_mentioned"].alias("robots_txt_mentioned"),
                r["llms_txt_mentioned"].alias("llms_txt_mentioned"),
            ),
        )

    with_lower = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"))
    return let(let(let(let(M.clean_for_scoring(raw), with_lower), measure), evaluate), finish)


def band(score: Column) -> Column:
    return (
        F.when(score <= 5, "weak_or_not_observed").when(score <= 10, "basic_limited")
        .when(score <= 15, "adequate_incomplete").otherwise("strong_citation_ready")
    )
