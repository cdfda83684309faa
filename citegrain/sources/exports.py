"""Compact export of page rows: column subset, text and list limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citegrain.functions.text import text_or_empty, truncate
from citegrain.operators.crawl import enrich_pages
from citegrain.operators.ordinals import first_or_all

OWNED_MARKDOWN_CHARS, OWNED_EXTRACT_CHARS, EXTERNAL_EXTRACT_CHARS = 60000, 12000, 8000
OWNED_LINKS, EXTERNAL_LINKS, PDF_LINKS = 75, 25, 25
MAX_FAILED, FAILED_ERROR_CHARS = 100, 500

# Exported columns of owned and external pages.
OWNED_COLUMNS = (
    "url", "final_url", "rank", "selection_reason", "mapping_quality", "mapping_score", "mapping_reason",
    "brand_topic_category", "related_queries_seed", "scrape_method", "resource_type", "crawl_status",
    "extraction_status", "content_score_policy", "geo_analysis_ready", "extraction_quality_score",
    "markdown_chars", "raw_markdown_chars", "title", "description", "status_code", "http_status_code",
    "resolved_url", "domain", "source_domain", "word_count", "text_chars", "canonical_url", "robots_meta",
    "language", "json_ld_present", "json_ld_block_count", "schema_types", "schema_types_detected", "metadata",
    "visible_dates", "content_regions", "geo_signals", "extraction_metrics", "content_metrics",
    "static_fetch", "rendered_fetch", "pdf_parser",
)
EXTERNAL_COLUMNS = (
    "title", "url", "source_url", "source_name", "source_domain", "source_type", "source_quality",
    "source_quality_notes", "source_category", "source_role", "snippet", "citation_count",
    "first_cited_position", "citation_position", "answer_support_weight", "supported_block_types",
    "is_owned_domain", "is_owned_ecosystem", "is_off_market", "is_social_or_forum", "is_low_authority",
    "selection_reason", "brand_topic_category", "related_queries_seed", "scrape_method", "resource_type",
    "crawl_status", "extraction_status", "geo_analysis_ready", "content_score_policy",
    "extraction_quality_score", "markdown_chars", "raw_markdown_chars", "description", "status_code",
    "http_status_code", "resolved_url", "domain", "word_count", "text_chars", "canonical_url",
    "robots_meta", "language", "json_ld_present", "json_ld_block_count", "schema_types",
    "schema_types_detected", "metadata", "visible_dates", "geo_signals", "extraction_metrics",
    "content_metrics",
)


def slim_pages(pages: DataFrame, external: bool = False, keys=("run_id",)) -> DataFrame:
    """Enriched pages reduced to the export columns, with texts and link lists cut.

    ``keys`` (run, position) are kept in front.
    """
    p = enrich_pages(pages, external=external)
    columns = EXTERNAL_COLUMNS if external else OWNED_COLUMNS
    keep = [c for c in columns if c in p.columns]
    text = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("content_extract", "main_text", "text")], F.lit(""))
    if external:
        text = F.coalesce(F.nullif(text, F.lit("")), F.col("markdown"), F.lit(""))
    limit, links = (EXTERNAL_EXTRACT_CHARS, EXTERNAL_LINKS) if external else (OWNED_EXTRACT_CHARS, OWNED_LINKS)
    extra = {"content_extract": truncate(text, limit)}
    if not external:
        extra["markdown"] = truncate(text_or_empty("markdown"), OWNED_MARKDOWN_CHARS)
    if "links" in p.columns:
        extra["links"] = F.slice("links", 1, links)
    pdfs = [c for c in ("pdf_links", "linked_pdfs") if c in p.columns]
    if pdfs:
        extra["pdf_links"] = F.slice(F.coalesce(*pdfs), 1, PDF_LINKS)
    return p.select(*[k for k in keys if k not in keep], *keep, *[c.alias(n) for n, c in extra.items()])


def slim_failed(failed: DataFrame, run: str = "run_id", order: str = "pos", n: int | None = MAX_FAILED) -> DataFrame:
    """The first ``n`` failed pages per run, or all without ``n``, with a shortened error."""
    rows = failed.select(
        run, order, F.coalesce(F.nullif("url", F.lit("")), F.col("source_url")).alias("url"), "crawl_status",
        "extraction_status", truncate(text_or_empty("error"), FAILED_ERROR_CHARS).alias("error"),
    )
    return first_or_all(rows, run, [order, "url"], n)


def export_counts(owned: DataFrame, external: DataFrame, failed: DataFrame, run: str = "run_id") -> DataFrame:
    """Page, scoreable and failed counts of the compact export per run."""
    ready = lambda texts: (text_or_empty("crawl_status") == "success") & (F.coalesce("word_count", F.lit(0)) >= 20) & texts
    has = lambda *names: F.greatest(*[F.length(text_or_empty(n)) for n in names], F.lit(0)) > 0
    o = owned.groupBy(run).agg(
        F.count("*").alias("owned_pages"), F.count_if(ready(has("markdown", "content_extract"))).alias("owned_pages_scoreable"))
    e = external.groupBy(run).agg(
        F.count("*").alias("external_pages"), F.count_if(ready(has("content_extract"))).alias("external_pages_scoreable"))
    f = failed.groupBy(run).agg(F.count("*").alias("external_failed_sources"))
    return o.join(e, run, "full_outer").join(f, run, "full_outer").na.fill(0)
