"""Page readiness: six dimensions of at most 20 points each, canonical rows and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import any_term, blank_split_count, first_present, let, occurrences, text_or_empty
from citegrain.operators.crawl import has_scored_signal
from citegrain.operators.frames import ensure_columns

DIMENSIONS = (
    "content_clarity", "semantic_depth", "structured_data", "eeat_signals", "freshness_index", "faq_readiness",
)
DIMENSION_MAX = 20
SCALE = 120

# Fixed patterns and terms of the scoring rule.
NUMERIC_EVIDENCE = r"(?iu)\d+[\d,.]*\s?(?:km|kwh|kw|円|万円|年|%|％|mm|kg|人|席)"
FRESHNESS_EVIDENCE = r"(?iu)20[2-3][0-9]|更新日|掲載日|last updated|valid until"
PROOF_TERMS = ("保証", "安全", "仕様", "諸元", "条件", "公式", "warranty", "safety", "specification", "official")
QUESTION_TERMS = ("?", "？", "faq", "よくある")

METHOD_FULL = "crawl_evidence_v1"
METHOD_LIMITED = "fallback_limited_v1"
METHOD_EXPLICIT = "explicit_page_geo_v1"
NOTE_FULL = (
    "Page-intrinsic GEO/readiness score computed from owned-page crawl text plus JSON-LD/schema, "
    "canonical and freshness signals."
)
NOTE_LIMITED = (
    "Limited fallback: full markdown crawl text was not available, so only metadata and technical "
    "signals were scored."
)
NOTE_EXPLICIT = (
    "Explicit page-level GEO/readiness score supplied by the Auditor or stored report bundle."
)

_INPUT = {
    "markdown": "string", "text": "string", "content_extract": "string", "title": "string",
    "page_title": "string", "meta_description": "string", "description": "string", "word_count": "bigint",
    "headings": "array<string>", "schema_types": "array<string>", "schema_types_detected": "array<string>",
    "json_ld_present": "boolean", "json_ld_block_count": "int", "canonical_url": "string",
    "final_url": "string", "crawl_status": "string",
}
_SCORES = (
    "current_geo_score_120", "score_120", "geo_readiness_score", "geo_score_120", "readiness_score",
)
_ROW = {
    **_INPUT, **{c: "double" for c in _SCORES}, "geo_dimensions": "map<string,double>", "scoring_method": "string",
    "scoring_notes": "string", "url": "string", "page_url": "string", "target_url": "string",
    "inventory_source": "string", "geo_analysis_ready": "boolean", "query_mapped": "boolean",
    "score_band": "string", "extraction_status": "string",
}


def _cap(c: Column, most: int) -> Column:
    return F.least(F.lit(most), c)


def _sum_of(low: Column, terms) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + occurrences(low, term)
    return out


def _fresh(text: Column, low: Column) -> Column:
    """``FRESHNESS_EVIDENCE`` without an alternation of words at every position."""
    held = lambda part, words: F.contains(low, F.lit(part)) & text.rlike(f"(?iu){words}")
    return text.rlike("20[2-3][0-9]") | any_term(text, ("更新日", "掲載日")) | held("updated", "last updated") | held("val", "valid until")


def readiness(pages: DataFrame) -> Column:
    """Struct ``score, dimensions, method, note`` from crawl evidence of one page row.

    Text is measured once (``let``); every rule after that is arithmetic on the measures.
    """
    has = lambda name: F.col(name) if name in pages.columns else F.lit(None).cast(_INPUT[name])
    markdown = F.coalesce(*[F.nullif(has(c), F.lit("")) for c in ("markdown", "text", "content_extract")], F.lit(""))
    title = F.coalesce(*[F.nullif(has(c), F.lit("")) for c in ("title", "page_title")], F.lit(""))
    description = F.coalesce(*[F.nullif(has(c), F.lit("")) for c in ("meta_description", "description")], F.lit(""))
    heading_count = F.coalesce(F.size(has("headings")), F.lit(0))
    schema_count = F.coalesce(F.size(F.coalesce(has("schema_types"), has("schema_types_detected"))), F.lit(0))
    linked_data = F.coalesce(has("json_ld_present"), F.lit(False)) | (F.coalesce(has("json_ld_block_count"), F.lit(0)) > 0)
    canonical = F.coalesce(F.nullif(has("canonical_url"), F.lit("")), F.nullif(has("final_url"), F.lit(""))).isNotNull()
    good_status = F.lower(text_or_empty(has("crawl_status"))).isin("success", "partial_success_empty_text")

    points = lambda test, n: F.when(test, n).otherwise(0)
    structured = _cap(points(linked_data, 12) + _cap(schema_count * 3, 8), DIMENSION_MAX)

    def measure(both: Column) -> Column:
        combined, low = both["text"], both["low"]
        return F.struct(
            F.coalesce(has("word_count"), blank_split_count(combined).cast("bigint")).alias("words"),
            F.regexp_count(combined, F.lit(NUMERIC_EVIDENCE)).alias("numbers"),
            _sum_of(low, QUESTION_TERMS).alias("questions"),
            _sum_of(low, PROOF_TERMS).alias("proofs"),
            _fresh(combined, low).alias("fresh"),
        )

    def score(m: Column) -> Column:
        full = (m["words"] >= 250) & (F.length(markdown) >= 500)
        zero = ~good_status & (m["words"] < 20)
        fresh_points = lambda n: points(m["fresh"], n)
        rich = {
            "content_clarity": _cap(
                points(title != "", 4) + points(description != "", 4) + points(m["words"] >= 300, 4)
                + points(heading_count >= 2, 4), DIMENSION_MAX),
            "semantic_depth": _cap(
                points(m["words"] >= 600, 4) + points(m["words"] >= 1200, 4) + _cap(m["numbers"], 6)
                + _cap(heading_count, 4), DIMENSION_MAX),
            "structured_data": structured,
            "eeat_signals": _cap(
                F.lit(2) + _cap(m["proofs"], 8) + _cap(m["numbers"], 6) + fresh_points(4), DIMENSION_MAX),
            "freshness_index": _cap(F.lit(4) + fresh_points(8) + points(canonical, 4), DIMENSION_MAX),
            "faq_readiness": _cap(_cap(m["questions"] * 3, 12), DIMENSION_MAX),
        }
        thin = {
            "content_clarity": points(title != "", 4),
            "semantic_depth": F.lit(0),
            "structured_data": structured,
            "eeat_signals": F.lit(2),
            "freshness_index": points(canonical, 4),
            "faq_readiness": F.lit(0),
        }
        dims = F.struct(*[
            F.when(full, F.when(zero, 0).otherwise(rich[d])).otherwise(thin[d]).cast("int").alias(d)
            for d in DIMENSIONS
        ])
        return let(dims, lambda d: F.struct(
            sum((d[name] for name in DIMENSIONS), F.lit(0)).alias("score"),
            d.alias("dimensions"),
            F.when(full, METHOD_FULL).otherwise(METHOD_LIMITED).alias("method"),
            F.when(full, NOTE_FULL).otherwise(NOTE_LIMITED).alias("note"),
        ))

    combined = F.concat(title, F.lit("\n"), description, F.lit("\n"), markdown)
    with_lower = lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"))
    return let(let(let(combined, with_lower), measure), score)


def clamp_dimensions(supplied) -> Column:
    """Supplied map of scores → whole points between 0 and 20."""
    c = F.col(supplied) if isinstance(supplied, str) else supplied
    return F.map_filter(
        F.transform_values(
            c, lambda _, v: F.greatest(F.lit(0), F.least(F.lit(DIMENSION_MAX), F.bround(v))).cast("int")
        ),
        lambda _, v: v.isNotNull(),
    )


def supplied_score(columns) -> Column:
    present = [F.col(c).cast("double") for c in _SCORES if c in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def canonical_rows(pages: DataFrame, mapped: str | None = None) -> DataFrame:
    """Readiness rows with one score: the supplied one, else computed from crawl evidence.

    ``mapped`` names a boolean column telling that a query is mapped to the page.
    """
    p = ensure_columns(pages, **_ROW)
    p = p.withColumn("url", U.first_url("url", "page_url", "target_url", "canonical_url", "final_url")).where("url != ''")
    is_mapped = F.coalesce(F.col("query_mapped"), F.lit(False))
    if mapped and mapped != "query_mapped":
        is_mapped = is_mapped | F.coalesce(F.col(mapped), F.lit(False))
    dims = F.coalesce(clamp_dimensions("geo_dimensions"), F.create_map().cast("map<string,int>"))
    given = supplied_score(p.columns)
    computed = (F.coalesce(given, F.lit(0.0)) == 0) & (F.size(dims) == 0)
    own = readiness(p)
    as_map = lambda d: F.create_map(*[x for name in DIMENSIONS for x in (F.lit(name), d[name])])
    p = p.withColumn("_own", F.when(computed, own))
    return p.select(
        *[c for c in pages.columns if c in ("run_id", "pos")],
        U.url_key("url").alias("url_key"),
        "url",
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("page_title", F.lit("")), F.lit("")).alias("title"),
        F.when(computed, F.col("_own.score").cast("double")).otherwise(F.coalesce(given, F.lit(0.0))).alias("current_geo_score_120"),
        F.when(computed, as_map(F.col("_own.dimensions"))).otherwise(dims).alias("geo_dimensions"),
        F.when(computed, F.col("_own.method")).otherwise(F.coalesce(F.nullif("scoring_method", F.lit("")), F.lit(METHOD_EXPLICIT))).alias("scoring_method"),
        F.when(computed, F.col("_own.note")).when(F.coalesce(F.col("scoring_method"), F.lit("")) == "", NOTE_EXPLICIT).otherwise(F.col("scoring_notes")).alias("scoring_notes"),
        is_mapped.alias("query_mapped"),
        F.coalesce(F.nullif("inventory_source", F.lit("")), F.when(is_mapped, "query_mapped").otherwise("sitemap_inventory")).alias("inventory_source"),
        "json_ld_present",
        "json_ld_block_count",
        F.coalesce("schema_types", "schema_types_detected", F.array().cast("array<string>")).alias("schema_types"),
        "crawl_status",
        first_present("canonical_url", "final_url").alias("canonical_url"),
        "word_count",
        "score_band",
        "extraction_status",
        "geo_analysis_ready",
    )


def scored_pages(pages: DataFrame) -> DataFrame:
    """Page rows that carry a score, a readiness flag or crawled text."""
    p = ensure_columns(pages, **_ROW)
    return p.where(has_scored_signal(supplied_score(p.columns)))


def readiness_rollup(rows: DataFrame, *keys) -> DataFrame:
    """Scoreable pages and mapped pages per key; rows are unique per url_key."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("owned_pages_scoreable"),
        F.count_if("query_mapped").alias("owned_query_mapped_unique"),
    )
