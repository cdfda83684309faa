"""Compact export of canonical evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from citegrain.operators import hygiene as H
from citegrain.sources import exports as X


def compact(canonical: dict[str, DataFrame], failed: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Slim pages, slim failures, hygiene recomputed on slim pages, and counts per run."""
    owned = X.slim_pages(canonical["owned_pages"], keys=("run_id", "pos"))
    external = X.slim_pages(canonical["external_pages"], external=True, keys=("run_id", "pos"))
    slim_failed = X.slim_failed(failed)
    coverage = H.coverage_with_files(owned, files)
    return {
        "owned_pages": owned,
        "external_pages": external,
        "failed_sources": slim_failed,
        "hygiene": H.hygiene(
            coverage.withColumnsRenamed({"robots_status": "_robots", "llms_status": "_llms"}),
            H.file_status("_robots"), H.file_status("_llms"),
        ).drop("_robots", "_llms"),
        "counts": X.export_counts(owned, external, slim_failed),
    }
