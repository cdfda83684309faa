"""Run artifacts on storage: JSON scans, listing, carry-forward, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from citegrain.operators.frames import first_wins
from citegrain.operators.registry import BASELINE_ARTIFACTS

# Where each required artifact may lie below a run, in order of preference.
ARTIFACT_PATHS = {
    "audit_context": ("outputs/audit_context/audit_context.json", "inputs/audit_context.json"),
    "evidence_scope": ("outputs/evidence_scope/evidence_scope.json",),
    "google_ai_mode_compact": ("outputs/google_ai_mode/google_ai_mode_compact.json",),
    "owned_pages_full": ("outputs/content_intelligence/owned_pages_full.json",),
    "external_pages_full": ("outputs/external_pages/external_pages_full.json",),
    "visibility_matrix": ("outputs/visibility/visibility_matrix.json",),
    "source_classification": ("outputs/source_landscape/source_classification.json",),
}
CORRUPT = "_corrupt_record"


def run_id_from_path(path: str = "_metadata.file_path", depth: int = 1):
    """Run folder name: the path part ``depth`` levels above the file."""
    parts = F.split(F.col(path), "/")
    return F.element_at(parts, -(depth + 1))


def read_artifact(spark: SparkSession, root: str, name: str, schema: str, keep_corrupt: bool = False) -> DataFrame:
    """One JSON document per run under ``root/<run_id>/<name>.json``, explicit schema.

    Missing files give no row; corrupt ones are dropped (or kept with ``_corrupt_record``).
    """
    declared = T.StructType.fromDDL(f"{schema}, {CORRUPT} string")
    rows = (
        spark.read.schema(declared).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).json(f"{root.rstrip('/')}/*/{name}.json")
        .withColumn("run_id", run_id_from_path())
    )
    return rows if keep_corrupt else rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``; only file metadata is read, never the content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length", "modificationTime")
    )


def locate_artifacts(files: DataFrame, root: str, candidates=ARTIFACT_PATHS) -> DataFrame:
    """(run_id, artifact, path): the first existing candidate of each artifact in each run.

    The candidate table is a constant of eight rows, so it becomes a map lookup.
    """
    table = F.create_map(*[
        x for name, paths in candidates.items() for rank, path in enumerate(paths)
        for x in (F.lit(path), F.struct(F.lit(name).alias("artifact"), F.lit(rank).alias("rank")))
    ])
    base = root.rstrip("/").split("/")[-1]
    below = F.regexp_extract("path", rf"/{base}/([^/]+)/(.*)$", 2)
    rows = files.withColumns({
        "run_id": F.regexp_extract("path", rf"/{base}/([^/]+)/(.*)$", 1), "_hit": F.try_element_at(table, below),
    }).where("_hit IS NOT NULL")
    return first_wins(
        rows.select("run_id", F.col("_hit.artifact").alias("artifact"), F.col("_hit.rank").alias("rank"), "path"),
        ["run_id", "artifact"], "rank",
    ).select("run_id", "artifact", "path")


def carry_forward(artifacts: DataFrame, source_run: str, target_run: str, names=BASELINE_ARTIFACTS) -> DataFrame:
    """Baseline rows of one run relabelled for another; partition pruning reads the source only."""
    return artifacts.where((F.col("run_id") == source_run) & F.col("artifact").isin(*names)).withColumn(
        "run_id", F.lit(target_run)
    )


def write_artifact(rows: DataFrame, path: str) -> None:
    """Replace the artifact of exactly the runs in ``rows``; other runs stay untouched.

    Rows are spread over several files per run rather than sent to one task per run.
    """
    (
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(path)
    )


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("run_id").json(path)
