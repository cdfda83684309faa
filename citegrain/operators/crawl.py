"""Crawl status rules, quality score and page enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import first_text, strip_ws, text_or_empty, word_count, word_or_cjk_count
from citegrain.operators.frames import ensure_columns, steps

MIN_WORDS = 20
BLOCKED_CODES = (401, 403, 429)
FAILED_STATUSES = ("failed", "blocked", "error", "partial_success_empty_text")
NOT_ATTEMPTED = ("", "not_requested", "pending")

TEXT_COLUMNS = ("markdown", "raw_markdown", "content_extract", "main_text", "text", "snippet", "description")
HINT_COLUMNS = {
    "title": "string", "source_name": "string", "source_type": "string", "snippet": "string",
    "citation_count": "bigint", "citation_position": "bigint", "first_cited_position": "bigint",
}
PAGE_COLUMNS = {
    **{c: "string" for c in TEXT_COLUMNS},
    **{c: "string" for c in (
        "url", "source_url", "final_url", "resolved_url", "canonical_url", "domain", "source_domain",
        "crawl_status", "extraction_status", "content_score_policy",
    )},
    **{c: "int" for c in ("http_status_code", "status_code", "response_status")},
    **{c: "bigint" for c in ("markdown_chars", "raw_markdown_chars", "text_chars", "word_count")},
    "geo_analysis_ready": "boolean",
    **HINT_COLUMNS,
}


def fetch_status(url, content_type, text, words=None) -> Column:
    """Status of one fetched resource from URL, content type and extracted text."""
    is_pdf = F.lower(text_or_empty(url)).endswith(".pdf") | F.contains(
        F.lower(text_or_empty(content_type)), F.lit("application/pdf")
    )
    body = text_or_empty(text)
    n = word_count(body) if words is None else words
    return (
        F.when(is_pdf & (body != ""), "success")
        .when(is_pdf, "empty_pdf_extract")
        .when(n >= MIN_WORDS, "success")
        .otherwise("empty_extract")
    )


def simple_fetch_status(url, content_type, text) -> Column:
    """Status rule of the plain fetcher: non-HTML is skipped, any text is a success."""
    html_like = F.contains(F.lower(text_or_empty(content_type)), F.lit("html")) | F.lower(
        text_or_empty(url)
    ).rlike(r"(?:\.html|\.htm|/)$")
    return (
        F.when(~html_like, "skipped_non_html")
        .when(text_or_empty(text) != "", "success")
        .otherwise("empty_extract")
    )


def page_snapshot(pages: DataFrame, content_type: Column | None = None, error: Column | None = None) -> DataFrame:
    """Fetched pages with extracted ``text`` → crawl records with word count and status."""
    kind = content_type if content_type is not None else F.lit("text/html")
    failed = error.isNotNull() if error is not None else F.lit(False)
    return (
        pages.withColumn("word_count", word_count("text").cast("bigint"))
        .withColumn(
            "crawl_status",
            F.when(failed, "failed").otherwise(fetch_status("url", kind, "text", F.col("word_count"))),
        )
        .withColumn("final_url", F.col("url"))
        .withColumn("source_url", F.col("url"))
    )


def extraction_quality(metrics: Column, status_code: Column, blocked: Column | None = None) -> Column:
    """Struct: score 0..1 from seven weighted steps, status, and whether scoring is allowed."""
    blocked = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
    blocked = blocked | F.coalesce(status_code.isin(*BLOCKED_CODES), F.lit(False))
    chars = metrics["markdown_chars"]
    ok_code = F.coalesce((status_code >= 200) & (status_code < 300), F.lit(False))
    # hundredths, so that the sum is exact
    points = (
        steps(chars, (2500, 25), (1000, 15), (400, 5))
        + steps(metrics["heading_count"], (5, 18), (2, 10))
        + steps(metrics["link_count"], (10, 15), (3, 8))
        + steps(metrics["image_count"], (3, 10), (1, 3))
        + steps(metrics["numeric_fact_count"], (5, 10), (1, 4))
        + F.when(metrics["table_like"], 10).otherwise(0)
        + F.when(ok_code, 12).otherwise(0)
    )
    score = F.bround(F.least(F.lit(100), points) / 100, 2)
    status = (
        F.when(blocked, "blocked")
        .when((points >= 45) & (chars >= 900), "success")
        .when(chars >= 300, "partial")
        .otherwise("failed")
    )
    return F.struct(
        score.alias("extraction_quality_score"), status.alias("extraction_status"),
        (status == "success").alias("scoring_allowed"),
    )


def _nonzero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def _present(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def enrich_pages(pages: DataFrame, external: bool = False, hint_prefix: str | None = None) -> DataFrame:
    """Deterministic crawl fields: aliases, hint fill, sizes, status repair, readiness flags.

    ``hint_prefix`` names citation-hint columns (``<prefix>title`` …) already joined to the row.
    """
    p = ensure_columns(pages, **PAGE_COLUMNS)
    hint = lambda name, kind="string": (
        F.col(hint_prefix + name) if hint_prefix and hint_prefix + name in p.columns else F.lit(None).cast(kind)
    )
    url = F.coalesce(_present("url"), _present("source_url"), F.nullif(hint("url"), F.lit("")))
    p = p.withColumn("url", url).withColumn("source_url", F.coalesce(_present("source_url"), F.col("url")))
    final = F.coalesce(_present("final_url"), _present("resolved_url"), _present("canonical_url"), F.col("url"))
    p = p.withColumns({"_final": final})
    p = p.withColumns({
        "final_url": F.coalesce(_present("final_url"), F.col("_final")),
        "resolved_url": F.coalesce(_present("resolved_url"), F.col("_final")),
        "domain": F.coalesce(
            _present("domain"), _present("source_domain"), F.nullif(hint("source_domain"), F.lit("")),
            F.nullif(U.host("url"), F.lit("")),
        ),
    }).drop("_final")
    p = p.withColumn("source_domain", F.coalesce(_present("source_domain"), F.col("domain")))
    fills = {}
    for name, kind in HINT_COLUMNS.items():
        own = _present(name) if kind == "string" else F.col(name)
        given = F.nullif(hint(name), F.lit("")) if kind == "string" else hint(name, kind)
        fills[name] = F.coalesce(own, given)
    p = p.withColumns(fills)
    code = F.coalesce(F.col("http_status_code"), _nonzero(F.col("status_code")), _nonzero(F.col("response_status")))
    p = p.withColumn("http_status_code", code).withColumn("status_code", F.coalesce("status_code", "http_status_code"))
    p = p.withColumn("_text", first_text(*TEXT_COLUMNS))
    p = p.withColumns({
        "markdown_chars": F.coalesce(
            _nonzero(F.col("markdown_chars")), F.length(F.coalesce(_present("markdown"), "_text"))).cast("bigint"),
        "raw_markdown_chars": F.coalesce(
            _nonzero(F.col("raw_markdown_chars")),
            F.length(F.coalesce(_present("raw_markdown"), _present("markdown"), "_text"))).cast("bigint"),
        "text_chars": F.coalesce(_nonzero(F.col("text_chars")), F.length("_text")).cast("bigint"),
        "word_count": F.coalesce(_nonzero(F.col("word_count")), word_or_cjk_count("_text")).cast("bigint"),
        "content_extract": F.coalesce(
            _present("content_extract"), F.nullif("_text", F.lit(""))),
    })
    p = p.withColumns({
        "main_text": F.coalesce(_present("main_text"), "content_extract"),
        "text": F.coalesce(_present("text"), "content_extract"),
    })
    given = F.lower(strip_ws(text_or_empty("crawl_status")))
    p = p.withColumn(
        "crawl_status",
        F.when((given == "success") & (F.col("text_chars") <= 0), "partial_success_empty_text")
        .when((given == "") & (F.col("text_chars") > 0), "success")
        .otherwise(F.col("crawl_status")),
    )
    success = F.lower(strip_ws(text_or_empty("crawl_status"))) == "success"
    extraction = F.lower(strip_ws(text_or_empty("extraction_status")))
    scoreable = success & (F.col("word_count") >= MIN_WORDS)
    score_policy = F.coalesce(_present("content_score_policy"), F.lit("benchmark_score")) if external else F.lit("score")
    default_policy = "citation_metadata_until_crawled" if external else "metadata_only_until_crawled"
    return p.withColumns({
        "extraction_status": F.when(
            success & (F.col("text_chars") > 0)
            & extraction.isin("", "pending", "not_requested", "empty_extract"), "success"
        ).otherwise(F.col("extraction_status")),
        "geo_analysis_ready": F.when(scoreable, True).otherwise(F.coalesce("geo_analysis_ready", F.lit(False))),
        "content_score_policy": F.when(scoreable, score_policy).otherwise(
            F.coalesce("content_score_policy", F.lit(default_policy))
        ),
    }).drop("_text")


def attempted(status="crawl_status") -> Column:
    return ~F.lower(text_or_empty(status)).isin(*NOT_ATTEMPTED)


def succeeded(status="crawl_status") -> Column:
    return text_or_empty(status) == "success"


def failed(status="crawl_status") -> Column:
    return text_or_empty(status).isin(*FAILED_STATUSES)


def scoreable() -> Column:
    return F.coalesce(F.col("geo_analysis_ready"), F.lit(False)) & (F.coalesce("word_count", F.lit(0)) >= MIN_WORDS)


def has_scored_signal(page_score: Column) -> Column:
    """A page row that carries a score, a readiness flag, or crawled text."""
    has_text = (F.coalesce("word_count", F.lit(0)) > 0) | (text_or_empty("markdown") != "") | (text_or_empty("text") != "")
    return (
        page_score.isNotNull()
        | F.coalesce(F.col("geo_analysis_ready"), F.lit(False))
        | ((F.lower(text_or_empty("crawl_status")) == "success") & has_text)
    )


def crawl_counters(pages: DataFrame, *keys) -> DataFrame:
    """Candidates, attempted, crawled, failed and scoreable pages per key."""
    return pages.groupBy(*keys).agg(
        F.count("*").alias("candidates"),
        F.count_if(attempted()).alias("attempted"),
        F.count_if(succeeded()).alias("crawled"),
        F.count_if(failed()).alias("failed"),
        F.count_if(scoreable()).alias("scoreable"),
    )


def run_telemetry(pages: DataFrame, citations: DataFrame | None = None, run: str = "run_id", kind: str = "kind") -> DataFrame:
    """One row per run: owned and external counters, citation total, success rate (4 decimals)."""
    parts = {"attempted": attempted(), "crawled": succeeded(), "failed": failed(), "scoreable": scoreable()}
    aggs = []
    for side in ("owned", "external"):
        is_side = F.col(kind) == side
        aggs.append(F.count_if(is_side).alias(f"{side}_page_candidates"))
        aggs += [F.count_if(is_side & test).alias(f"{side}_pages_{name}") for name, test in parts.items()]
    out = pages.groupBy(run).agg(*aggs)
    if citations is not None:
        totals = citations.groupBy(run).agg(F.sum("citation_count").alias("external_citation_count"))
        out = out.join(totals, run, "left").withColumn(
            "external_citation_count", F.coalesce("external_citation_count", F.lit(0))
        )
    tried = F.col("owned_pages_attempted") + F.col("external_pages_attempted")
    crawled = F.col("owned_pages_crawled") + F.col("external_pages_crawled")
    return out.withColumn("crawl_success_rate", F.bround(crawled / F.nullif(tried, F.lit(0)), 4))


def collection_summary(pages: DataFrame, *keys) -> DataFrame:
    """Requested, collected, weak and failed pages per key, with the overall status."""
    status = text_or_empty("crawl_status")
    weak, bad = status.isin("weak", "partial"), status.isin("failed", "blocked", "error")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages_requested"),
        F.count_if(status == "success").alias("pages_collected"),
        F.count_if(weak).alias("pages_weak"),
        F.count_if(bad).alias("pages_failed"),
        F.when(F.count_if(bad) > 0, "partial").otherwise("success").alias("status"),
    )
