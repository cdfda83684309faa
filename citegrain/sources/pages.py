"""Page tables and the text or manifest files that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegrain.functions import markdown as M
from citegrain.functions.text import compact_block, compact_limited, text_or_empty

MANIFEST_SCHEMA = (
    "metadata struct<canonical:string,robots:string,language:string,schema_types:array<string>,"
    "json_ld_present:boolean,json_ld_block_count:int,schema_block_count:int>, "
    "links array<struct<url:string,text:string>>, linked_pdfs array<struct<url:string,text:string>>, "
    "visible_dates array<string>, geo_analysis_ready boolean, content_score_policy string, "
    "extraction_quality_score double, extraction_metrics struct<wordish_count:int,heading_count:int,"
    "question_count:int,table_line_count:int,link_count:int,numeric_fact_count:int>, "
    "static_fetch struct<final_url:string>, rendered_fetch struct<final_url:string>"
)


def relative_path(column: str, root: str):
    base = root.rstrip("/").split("/")[-1]
    return F.regexp_extract(F.col(column), rf"/{base}/(.*)$", 1)


def read_texts(spark: SparkSession, root: str, suffix: str = "*.md") -> DataFrame:
    """(path, value): whole text files below ``root``."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
        .text(root, wholetext=True).select(relative_path("_metadata.file_path", root).alias("path"), "value")
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root)
        .select(relative_path("_metadata.file_path", root).alias("path"), F.struct("*").alias("manifest"))
    )


def with_side_files(
    rows: DataFrame, texts: DataFrame, manifests: DataFrame, inline_chars: int | None = None, extract_chars: int | None = None,
) -> DataFrame:
    """Page rows with their Markdown and manifest fields; texts are whole unless the caller gives a length.

    ``rows``: url, markdown_file, manifest_file. Paths are unique, so both joins are 1:1.
    """
    t = texts.select(F.col("path").alias("markdown_file"), F.col("value").alias("_md"))
    m = manifests.select(F.col("path").alias("manifest_file"), "manifest")
    j = rows.join(t, "markdown_file", "left").join(m, "manifest_file", "left")
    md = text_or_empty("_md")
    empty_links = F.array().cast("array<struct<url:string,text:string>>")
    types = F.coalesce("manifest.metadata.schema_types", F.array().cast("array<string>"))
    links, pdfs = F.coalesce("manifest.links", empty_links), F.coalesce("manifest.linked_pdfs", empty_links)
    return j.withColumns({
        "markdown": md if inline_chars is None else F.left(md, F.lit(inline_chars)),
        "raw_markdown_chars": F.length(md).cast("bigint"),
        "content_extract": compact_block(md) if extract_chars is None else compact_limited(md, extract_chars),
        "links": links,
        "linked_pdfs": pdfs,
        "schema_types": types,
        "json_ld_present": F.coalesce("manifest.metadata.json_ld_present", F.lit(False)),
        "json_ld_block_count": F.coalesce(
            F.nullif("manifest.metadata.json_ld_block_count", F.lit(0)), F.col("manifest.metadata.schema_block_count"), F.lit(0)),
        "canonical_url": text_or_empty("manifest.metadata.canonical"),
        "robots_meta": text_or_empty("manifest.metadata.robots"),
        "language": text_or_empty("manifest.metadata.language"),
        "final_url": F.coalesce(
            F.nullif("manifest.rendered_fetch.final_url", F.lit("")), F.nullif("manifest.static_fetch.final_url", F.lit("")), F.col("url")),
        "geo_analysis_ready": F.col("manifest.geo_analysis_ready"),
        "content_score_policy": F.col("manifest.content_score_policy"),
        "extraction_quality_score": F.col("manifest.extraction_quality_score"),
        "content_metrics": M.content_metrics(md, F.col("manifest.extraction_metrics"), F.size(links), F.size(pdfs), inline_chars),
    }).drop("_md", "manifest")
