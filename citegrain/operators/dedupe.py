"""Order-preserving distinct, inventories and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from citegrain.functions import url as U
from citegrain.functions.text import compact
from citegrain.operators.frames import first_n, first_wins


def distinct_urls(rows: DataFrame, keys=("run_id",), url: str = "url", order: str = "pos") -> DataFrame:
    """Valid URLs, fragment dropped, first occurrence kept."""
    clean = rows.withColumn(url, U.valid_url(url)).where(F.col(url).isNotNull())
    return first_wins(clean, [*keys, url], order)


def distinct_queries(rows: DataFrame, keys=("run_id",), query: str = "query", order: str = "pos") -> DataFrame:
    """Queries distinct by compacted lower-case text, first occurrence kept."""
    keyed = rows.withColumn("_key", F.lower(compact(query))).where("_key != ''")
    return first_wins(keyed, [*keys, "_key"], order).drop("_key")


def distinct_by(rows: DataFrame, value: str, keys=(), order: str = "pos") -> DataFrame:
    """Generic first-wins distinct on a value of any type (nested values by their JSON)."""
    kind = rows.schema[value].dataType.typeName()
    key = F.to_json(value) if kind in ("struct", "array", "map") else F.col(value).cast("string")
    keyed = rows.withColumn("_key", key).where("_key IS NOT NULL AND _key != ''")
    return first_wins(keyed, [*keys, "_key"], order).drop("_key")


def split_owned(urls: DataFrame, domains: DataFrame, scope=("run_id",), url: str = "url") -> DataFrame:
    """Add ``is_owned``: the host equals or lies below one of the scope's domains.

    The suffix test runs once per distinct host as an equi-join on host suffixes, so URL
    rows are never multiplied and the domain side may grow with the number of brands.
    """
    scope = list(scope)
    hosted = urls.withColumn("_host", U.authority(url))
    suffixes = hosted.select(*scope, "_host").distinct().select(
        *scope, "_host", F.explode(U.host_suffixes("_host")).alias("_suffix")
    )
    known = domains.select(*scope, F.lower("domain").alias("_suffix")).distinct()
    owned_hosts = suffixes.join(known, [*scope, "_suffix"], "left_semi").select(*scope, "_host").distinct()
    return (
        hosted.join(owned_hosts.withColumn("_owned", F.lit(True)), [*scope, "_host"], "left")
        .withColumn("is_owned", F.coalesce("_owned", F.lit(False)))
        .drop("_host", "_owned")
    )


def owned_domains(configured: DataFrame, scope=("run_id",), domain: str = "domain") -> DataFrame:
    """Configured domains with their bare and www forms, distinct per scope."""
    return configured.select(*scope, F.explode(U.owned_domain_forms(domain)).alias("domain")).distinct()


def inventory(sources: list[DataFrame], domains: DataFrame, max_owned: int, max_external: int, key: str = "run_id") -> DataFrame:
    """URLs of several artifacts in order → distinct, split by ownership, first n of each side.

    Every source has ``run_id, pos, url``; sources count in list order.
    """
    rows = None
    for part, frame in enumerate(sources):
        ordered = frame.select(key, "url", F.struct(F.lit(part).alias("part"), F.col("pos").cast("bigint").alias("pos")).alias("pos"))
        rows = ordered if rows is None else rows.unionByName(ordered)
    unique = split_owned(distinct_urls(rows, (key,)), domains, (key,))
    sides = first_n(unique, [key, "is_owned"], ["pos", "url"], max(max_owned, max_external))
    return sides.where(F.col("rank") <= F.when(F.col("is_owned"), max_owned).otherwise(max_external))


def selected_pages(scope_rows: DataFrame, key: str = "run_id", seed_limit: int | None = None):
    """Pages chosen by queries → (pages distinct by URL with first attributes, related query rows).

    ``scope_rows``: run_id, pos, url, brand_topic_category, query_id, query, query_type, priority
    and any page attributes; one row per (query, page). Related queries stay rows of their own,
    since one popular page may be chosen by very many queries.
    """
    related = scope_rows.select(key, "url", "pos", "query_id", "query", "brand_topic_category", "query_type", "priority")
    attributes = scope_rows.drop("query_id", "query", "query_type", "priority")
    pages = first_wins(attributes, [key, "url"], "pos")
    if seed_limit:
        related = first_n(related, [key, "url"], ["pos"], seed_limit)
    return pages, related


def with_batches(rows: DataFrame, size: int, key: str = "run_id", order: str = "pos") -> DataFrame:
    """Batch number of every row: consecutive chunks of ``size`` in order, per key."""
    from citegrain.operators.ordinals import ordinals

    return ordinals(rows, key, order, "_n").withColumn(
        "batch", F.floor((F.col("_n") - 1) / max(1, size)).cast("bigint")
    ).drop("_n")
