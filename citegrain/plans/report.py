"""Report bundle: readiness rows of report and artifacts, mapped pages, citations, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.operators import citations as C
from citegrain.operators import merging, readiness as R, registry


def enrich(report_rows: DataFrame, artifact_pages: list[DataFrame], workbench: DataFrame,
           recommendations: DataFrame, citations: DataFrame) -> dict[str, DataFrame]:
    """Readiness, related queries, distinct citations and rollup for many runs.

    ``report_rows`` and every artifact layer: run_id, pos, url and any page columns; the report
    wins over artifacts, earlier layers over later ones.
    """
    mapped = merging.mapped_pages(workbench, recommendations)
    layers = [R.canonical_rows(report_rows)] + [R.canonical_rows(R.scored_pages(p)) for p in artifact_pages]
    rows = merging.mark_mapped(merging.merge_report_rows(*layers), mapped)
    rows = rows.withColumn(
        "inventory_source",
        F.when(F.col("query_mapped") & (F.col("inventory_source") == "sitemap_inventory"), "query_mapped")
        .otherwise(F.col("inventory_source")),
    )
    return {
        "readiness": rows,
        "related_queries": merging.related_queries(workbench),
        "citations": C.distinct_citations(citations, scope=("run_id",)),
        "rollup": R.readiness_rollup(rows, "run_id"),
    }


def manifests(runs: DataFrame, enriched: dict[str, DataFrame], workbench: DataFrame, completed_epoch: Column) -> DataFrame:
    """One manifest per run; runs without any recognised content are stored but not promoted."""
    asked = workbench.select("run_id", "query_id").distinct()
    counts = registry.manifest_counts(asked, enriched["readiness"], enriched["citations"])
    j = runs.join(counts, "run_id", "left").na.fill(0)
    ready = registry.has_report_payload({
        "query_workbench": F.col("query_count"), "owned_url_readiness": F.col("owned_pages_scoreable"),
    })
    return j.withColumns({
        "dashboard_ready": ready,
        "status": F.when(ready, "completed").otherwise("completed_invalid_report"),
        "stage": F.when(ready, "report_bundle_ready").otherwise("report_bundle_invalid"),
        "created_at_epoch": completed_epoch, "completed_at_epoch": completed_epoch,
    })
