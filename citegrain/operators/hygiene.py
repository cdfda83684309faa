"""AI-discoverability hygiene: structured-data coverage, file statuses, priority, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import percent_text, strip_ws, text_or_empty
from citegrain.operators.frames import ensure_columns, first_n, first_wins


# Words meaning available, not found, not checked.
AVAILABLE = ("available", "present", "success", "fetched")
NOT_FOUND = ("not found", "missing", "absent", "404", "error", "failed")
NOT_CHECKED = ("not checked", "notchecked", "not requested", "pending", "")
NOT_FULLY_CHECKED_SUMMARY = (
    "AI discoverability hygiene was not fully checked. Robots.txt, LLMs.txt, "
    "or JSON-LD crawl signals are missing from this evidence run."
)

PAGE_COLUMNS = {
    "url": "string", "final_url": "string", "resolved_url": "string", "source_url": "string", "title": "string",
    "json_ld_present": "boolean", "json_ld_block_count": "int", "schema_block_count": "int",
    "schema_types": "array<string>", "schema_types_detected": "array<string>", "crawl_status": "string",
    "extraction_status": "string",
}


def file_status(status, attempts: Column | None = None, http_code: Column | None = None, url: Column | None = None) -> Column:
    """available / not found / not checked from a status word and evidence of an attempt."""
    word = F.replace(F.lower(strip_ws(text_or_empty(status))), F.lit("_"), F.lit(" "))
    tried = F.lit(False)
    if attempts is not None:
        tried = tried | (F.coalesce(attempts, F.lit(0)) > 0)
    if http_code is not None:
        tried = tried | (F.coalesce(http_code, F.lit(0)) != 0)
    if url is not None:
        tried = tried | (text_or_empty(url) != "")
    return (
        F.when(word.isin(*AVAILABLE), "available")
        .when(word.isin(*NOT_FOUND), "not found")
        .when(word.isin(*NOT_CHECKED) & tried, "not found")
        .otherwise("not checked")
    )


def file_record(status, url: Column | None = None, attempts: Column | None = None, http_code: Column | None = None,
                sitemap_entries: Column | None = None, chars: Column | None = None) -> Column:
    """Struct of a file's status with its url, number of sitemap entries and size; what is blank or no whole number is NULL.

    An empty count is zero, a missing one is NULL.
    """
    whole = lambda c: F.lit(None).cast("int") if c is None else F.when(strip_ws(c.cast("string")) == "", 0).otherwise(c.cast("string").try_cast("int"))
    address = F.lit(None).cast("string") if url is None else F.nullif(url, F.lit(""))
    return F.struct(
        file_status(status, attempts, http_code, url).alias("status"), address.alias("url"),
        whole(sitemap_entries).alias("sitemap_entries_count"), whole(chars).alias("chars"),
    )


def page_types() -> Column:
    """Distinct non-empty schema types of a page, first-seen order."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce("schema_types", empty), F.coalesce("schema_types_detected", empty))
    return F.array_distinct(F.filter(F.transform(both, lambda t: strip_ws(text_or_empty(t))), lambda t: t != ""))


def with_structured_flags(pages: DataFrame) -> DataFrame:
    p = ensure_columns(pages, **PAGE_COLUMNS).withColumn("_types", page_types())
    blocks = F.coalesce("json_ld_block_count", "schema_block_count", F.lit(0))
    status = F.lower(F.coalesce(F.nullif("crawl_status", F.lit("")), F.col("extraction_status"), F.lit("")))
    return p.withColumns({
        "_json_ld": F.coalesce(F.col("json_ld_present"), F.lit(False)) | (blocks > 0),
        "_signal": F.col("json_ld_present").isNotNull() | F.col("json_ld_block_count").isNotNull()
        | (F.size("_types") > 0)
        | ((status == "success") & (F.col("schema_types").isNotNull() | F.col("schema_types_detected").isNotNull())),
    })


def structured_coverage(pages: DataFrame, *keys) -> DataFrame:
    """Pages, pages with schema and JSON-LD, coverage in percent (1 decimal), checked flag."""
    p = with_structured_flags(pages)
    with_ld = F.count_if("_json_ld")
    return p.groupBy(*keys).agg(
        F.count("*").alias("owned_pages_total"),
        F.count_if(F.col("_json_ld") | (F.size("_types") > 0)).alias("pages_with_schema"),
        with_ld.alias("pages_with_json_ld"),
        F.bround(with_ld / F.count("*") * 100, 1).alias("coverage_pct"),
        F.bool_or("_signal").alias("structured_checked"),
    )


def coverage_with_files(pages: DataFrame, files: DataFrame, key: str = "run_id") -> DataFrame:
    """Coverage rows beside the fetched-file columns of ``files``; runs known from files alone have zeros, unchecked."""
    counts = {name: F.coalesce(name, F.lit(0)).cast("bigint") for name in ("owned_pages_total", "pages_with_schema", "pages_with_json_ld")}
    rows = structured_coverage(pages, key).join(files, key, "full")
    return rows.withColumns(counts).withColumns({
        "coverage_pct": F.coalesce("coverage_pct", F.lit(0.0)), "structured_checked": F.coalesce("structured_checked", F.lit(False)),
    })


def schema_type_counts(pages: DataFrame, *keys, order: str = "pos") -> DataFrame:
    """Pages per schema type, most frequent first, ties by first appearance (``rank``)."""
    from pyspark.sql import Window

    p = with_structured_flags(pages).select(*keys, F.col(order).alias("_pos"), F.posexplode_outer("_types").alias("_tpos", "schema_type")).where("_tpos IS NOT NULL")
    counted = p.groupBy(*keys, "schema_type").agg(
        F.count("*").alias("pages"), F.min(F.struct("_pos", "_tpos")).alias("_first")
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("pages"), "_first")
    return counted.withColumn("rank", F.row_number().over(w)).drop("_first")


def missing_json_ld(pages: DataFrame, *keys, order: str = "pos", n: int | None = None) -> DataFrame:
    """Pages without JSON-LD per key; with ``n`` the first ones in input order, ranked."""
    p = with_structured_flags(pages).where("NOT _json_ld")
    rows = p.select(
        *keys, F.col(order).alias("pos"),
        F.coalesce(*[F.nullif(c, F.lit("")) for c in ("url", "final_url", "resolved_url", "source_url")]).alias("url"),
        F.nullif("title", F.lit("")).alias("title"),
    )
    return rows if n is None else first_n(rows, keys, ["pos", "url"], n)


def priority(coverage_pct: Column, robots: Column, llms: Column, checked: Column) -> Column:
    unchecked = (robots == "not checked") | (llms == "not checked") | ~F.coalesce(checked, F.lit(False))
    coverage = F.coalesce(coverage_pct, F.lit(0.0))
    return F.when(unchecked | (coverage < 50), "high").when(coverage < 80, "medium").otherwise("low")


def _file_phrase(name: str, status: Column) -> Column:
    return F.when(status == "available", f"{name} is available").when(
        status == "not found", f"{name} was not found").otherwise(f"{name} was not checked")


def hygiene(coverage: DataFrame, robots: Column, llms: Column) -> DataFrame:
    """Add robots/llms status, priority and the one-sentence summary to coverage rows."""
    c = coverage.withColumns({"robots_status": robots, "llms_status": llms})
    unchecked = (
        (F.col("robots_status") == "not checked") | (F.col("llms_status") == "not checked")
        | ~F.coalesce("structured_checked", F.lit(False))
    )
    sentence = F.concat(
        F.lit("JSON-LD/schema coverage: "), F.col("pages_with_json_ld").cast("string"), F.lit("/"),
        F.col("owned_pages_total").cast("string"), F.lit(" owned pages ("), percent_text("coverage_pct"), F.lit("%). "),
        _file_phrase("Robots.txt", F.col("robots_status")), F.lit("; "),
        _file_phrase("LLMs.txt", F.col("llms_status")), F.lit("."),
    )
    return c.withColumns({
        "priority": priority(F.col("coverage_pct"), F.col("robots_status"), F.col("llms_status"), F.col("structured_checked")),
        "summary": F.when(unchecked, NOT_FULLY_CHECKED_SUMMARY).otherwise(sentence),
    })


def is_valid_hygiene() -> Column:
    """A stored record with priority, summary and all three parts."""
    out = F.lit(True)
    for name in ("priority", "summary", "robots_status", "llms_status", "owned_pages_total"):
        out = out & F.col(name).isNotNull()
    return out


def hygiene_by_source(*candidates: DataFrame, key: str = "run_id") -> DataFrame:
    """First valid record per run in the given order of sources (stored, nested, recomputed)."""
    ranked = None
    for rank, frame in enumerate(candidates):
        part = frame.where(is_valid_hygiene()).withColumn("source_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    return first_wins(ranked, key, "source_rank")


def base_candidates(domains: DataFrame, discovered: DataFrame, pages: DataFrame, key: str = "run_id") -> DataFrame:
    """Ordered distinct ``scheme://host`` bases: domain and its www3/www2 forms, discovery, pages.

    Inputs: domains(run_id, domain), discovered(run_id, pos, url), pages(run_id, pos, url).
    """
    from_domain = domains.select(key, F.lit(0).alias("part"), F.posexplode(U.base_variants("domain")).alias("pos", "base"))
    rest = [
        frame.select(key, F.lit(part).alias("part"), F.col("pos").cast("int").alias("pos"), U.base_url("url").alias("base"))
        for part, frame in ((1, discovered), (2, pages))
    ]
    rows = from_domain.unionByName(rest[0]).unionByName(rest[1]).where("base IS NOT NULL")
    return rows.groupBy(key, "base").agg(F.min(F.struct("part", "pos")).alias("first_seen"))
