"""Merging page rows, hints, report rows and query-mapping marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import text_or_empty
from citegrain.operators.citations import citation_hints
from citegrain.operators.frames import first_wins

ALIASES = ("url", "source_url", "final_url", "resolved_url")


def alias_index(pages: DataFrame, run: str = "run_id", order: str = "pos", aliases=ALIASES) -> DataFrame:
    """Every URL a page answers to → position of the page; the earliest page wins."""
    names = [F.col(a) for a in aliases if a in pages.columns]
    rows = pages.select(run, F.col(order).alias("page_pos"), F.posexplode(F.array_distinct(F.array(*names))).alias("_a", "alias"))
    rows = rows.where(text_or_empty("alias") != "")
    return rows.groupBy(run, "alias").agg(F.min(F.struct("page_pos", "_a"))["page_pos"].alias("page_pos"))


def merge_pages(existing: DataFrame, crawled: DataFrame, run: str = "run_id", order: str = "pos") -> DataFrame:
    """Existing rows enriched by the crawled page of their URL, then crawled pages not used yet.

    Crawled values win where present. A crawled page reachable under several URLs is added
    once. Result order: ``merge_pos`` = (0, existing position) or (1, crawled position).
    """
    index = alias_index(crawled, run, order)
    lookup = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("url", "source_url", "final_url") if c in existing.columns])
    keyed = existing.withColumn("_lookup", lookup).join(
        index.withColumnRenamed("alias", "_lookup"), [run, "_lookup"], "left"
    )
    shared = [c for c in crawled.columns if c not in (run, order)]
    right = crawled.select(run, F.col(order).alias("page_pos"), *[F.col(c).alias(f"_c_{c}") for c in shared])
    joined = keyed.join(right, [run, "page_pos"], "left")
    names = [c for c in existing.columns if c not in (run, order)]
    every = names + [c for c in shared if c not in names]
    value = lambda c: F.coalesce(
        *([F.col(f"_c_{c}")] if c in shared else []), *([F.col(c)] if c in names else [])
    ).alias(c)
    enriched = joined.select(run, F.struct(F.lit(0).alias("side"), F.col(order).alias("pos")).alias("merge_pos"), *[value(c) for c in every])
    used = keyed.where("page_pos IS NOT NULL").select(run, "page_pos").distinct()
    added = (
        crawled.withColumnRenamed(order, "page_pos").join(used, [run, "page_pos"], "left_anti")
        .select(run, F.struct(F.lit(1).alias("side"), F.col("page_pos").alias("pos")).alias("merge_pos"),
                *[F.col(c) if c in shared else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in every])
    )
    return enriched.unionByName(added)


def fill_from_hints(pages: DataFrame, candidates: DataFrame, columns, run: str = "run_id", prefix: str = "hint_") -> DataFrame:
    """External pages with hint columns (``hint_title`` …) from citations of the same URL."""
    hints = citation_hints(candidates, columns, (run,))
    renamed = hints.select(run, F.col("url").alias("_u"), *[F.col(c).alias(prefix + c) for c in columns])
    key = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("url", "source_url") if c in pages.columns])
    return pages.withColumn("_u", key).join(renamed, [run, "_u"], "left").drop("_u")


# Zero means "no score yet" here; other numbers count as present when zero.
ZERO_IS_EMPTY = ("current_geo_score_120",)


def _empty(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    if name in ZERO_IS_EMPTY:
        return c.isNull() | (c == 0)
    return c.isNull()


def merge_report_rows(*layers: DataFrame, run: str = "run_id", key: str = "url_key") -> DataFrame:
    """Readiness rows of several layers per page: each field from the first layer that has it.

    Layers are given by precedence (stored report first, artifacts after); within a layer the
    earlier row wins. ``query_mapped`` is true when any layer says so.
    """
    rows = None
    for rank, layer in enumerate(layers):
        part = layer.withColumn("_prio", F.struct(F.lit(rank).alias("layer"), F.col("pos").cast("bigint").alias("pos")))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.where(F.col(key) != "")
    fields = [f for f in rows.schema.fields if f.name not in (run, key, "_prio", "pos", "query_mapped")]
    picks = [
        F.min_by(F.col(f.name), F.when(~_empty(f.name, f.dataType.simpleString()), F.col("_prio"))).alias(f.name)
        for f in fields
    ]
    marks = [F.coalesce(F.bool_or("query_mapped"), F.lit(False)).alias("query_mapped")] if "query_mapped" in rows.columns else []
    return rows.groupBy(run, key).agg(*picks, *marks)


def mapped_pages(workbench: DataFrame, recommendations: DataFrame, run: str = "run_id") -> DataFrame:
    """Pages with a mapped query: from the workbench or a recommendation, with related query counts.

    ``workbench``: run_id, query_id, query, url; ``recommendations``: run_id, url.
    """
    asked = text_or_empty(F.col("query_id").cast("string")) != ""
    asked = asked | (text_or_empty("query") != "")
    rows = workbench.select(run, U.url_key("url").alias("url_key"), asked.cast("int").alias("related")).unionByName(
        recommendations.select(run, U.url_key("url").alias("url_key"), F.lit(0).alias("related"))
    )
    return rows.where("url_key != ''").groupBy(run, "url_key").agg(F.sum("related").alias("related_queries"))


def related_queries(workbench: DataFrame, run: str = "run_id") -> DataFrame:
    """(page, query) rows of the workbench, in order of ``pos``."""
    return workbench.select(
        run, U.url_key("url").alias("url_key"), "pos", "query_id", "query",
        *[c for c in ("visibility_status",) if c in workbench.columns],
    ).where("url_key != '' AND (coalesce(cast(query_id as string), '') != '' OR coalesce(query, '') != '')")


def mark_mapped(rows: DataFrame, mapped: DataFrame, run: str = "run_id") -> DataFrame:
    flags = mapped.select(run, "url_key", F.lit(True).alias("_mapped"))
    return rows.join(flags, [run, "url_key"], "left").withColumn(
        "query_mapped", F.coalesce("query_mapped", F.lit(False)) | F.coalesce("_mapped", F.lit(False))
    ).drop("_mapped")


def keep_richer(candidates: DataFrame, key, priority: Column, order: str = "pos") -> DataFrame:
    """One candidate per key, lowest priority number first: completed rows before placeholders."""
    ranked = candidates.withColumn("_p", priority)
    return first_wins(ranked, key, ["_p", order]).drop("_p")
