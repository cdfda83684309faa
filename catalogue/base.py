"""Registration of queries with their SQL, and the driver tables recast as evidence tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegrain.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

OWNED = ("example.com", "example.org")


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


SPREAD_TABLES = ("documents", "pages", "conversations", "lineitem")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; the larger ones, when of few splits, are spread over the cores first."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quoted(v) for v in values)


def epoch(c: str | Column) -> Column:
    """Epoch seconds of a timestamp column."""
    return F.floor(F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / 1000000).cast("bigint")



# Market names by nation key, so that nations behave like markets.
MARKETS = (
    "Japan", "United States", "UK", "Germany", "France", "Italy", "Spain", "Canada", "Australia", "India",
    "China", "South Korea", "Brazil", "Mexico", "Netherlands", "Sweden", "Norway", "Atlantis", "us", "Global",
    "New Zealand", " Peru ", "de", "", "Egypt",
)
MARKETS_SQL = "[" + in_list(MARKETS) + "]"


def market_of(nationkey: str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MARKETS]), F.col(nationkey) + 1)


# --- citations from lineitem -------------------------------------------------------------

CITATION_ORDER = ("citation_position", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
SOURCE_TYPES = ("owned_brand", "authority_body", "news_media", "forum_community", "publisher_review")


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as citations: order = query, line number = position, supplier = site."""
    kind = F.element_at(F.array(*[F.lit(s) for s in SOURCE_TYPES]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run_id"),
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").cast("bigint").alias("citation_position"),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.net/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".example.net")).alias("source_domain"),
        F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(kind).alias("source_type"),
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    )


CITATIONS_SQL = f"""
SELECT l_returnflag AS run_id, l_orderkey AS query_id, l_linenumber::BIGINT AS citation_position,
       'https://s' || l_suppkey || '.example.net/p/' || l_partkey AS url,
       's' || l_suppkey || '.example.net' AS source_domain,
       CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE ([{in_list(SOURCE_TYPES)}])[l_suppkey % 5 + 1] END AS source_type,
       l_partkey, l_suppkey, l_shipdate, l_extendedprice
FROM lineitem"""
CITATION_ORDER_SQL = "citation_position, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


# --- run registry from orders ------------------------------------------------------------

def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as run manifests: F completed, O running, P failed; segment = brand, nation = market."""
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("c_mktsegment").alias("brand"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("market"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("https://www.c"), (F.col("o_custkey") % 2).cast("string"), F.lit(".example.com")))
        .alias("domain"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", "report_bundle_ready").otherwise("evidence_ready").alias("stage"),
        (F.col("o_orderkey") % 11 != 0).alias("dashboard_ready"),
        epoch("o_orderdate").alias("created_at_epoch"),
        F.when(F.col("o_orderkey") % 5 != 0, epoch("o_orderdate") + 3600).alias("completed_at_epoch"),
        (F.col("o_orderkey") % 13 != 0).alias("has_payload"),
    )


MANIFESTS_SQL = """
SELECT o_orderkey::VARCHAR AS run_id, c_mktsegment AS brand, 'Nation ' || c_nationkey AS market,
       CASE WHEN o_custkey % 3 = 0 THEN 'https://www.c' || (o_custkey % 2) || '.example.com' END AS domain,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN 'report_bundle_ready' ELSE 'evidence_ready' END AS stage,
       o_orderkey % 11 <> 0 AS dashboard_ready,
       (epoch_us(o_orderdate) // 1000000)::BIGINT AS created_at_epoch,
       CASE WHEN o_orderkey % 5 <> 0 THEN (epoch_us(o_orderdate) // 1000000)::BIGINT + 3600 END AS completed_at_epoch,
       o_orderkey % 13 <> 0 AS has_payload
FROM orders JOIN customer ON o_custkey = c_custkey"""
READY_SQL = "coalesce(dashboard_ready, true) AND stage = 'report_bundle_ready' AND status = 'completed'"
RECENCY_SQL = "coalesce(nullif(completed_at_epoch, 0), nullif(created_at_epoch, 0), 0)"


def key_sql(c: str) -> str:
    """The registry key of a SQL expression."""
    return (
        f"translate(replace(replace(lower(trim(coalesce({c}, ''))), 'https://', ''), 'http://', ''), '/ :', '___')"
    )


# --- status events -----------------------------------------------------------------------

EVENT_STATUS = {
    "signup": ("accepted", "initialising"), "view": ("running", "crawl_refresh_running"),
    "click": ("running", "auditor_running"), "error": ("failed", None), "purchase": ("completed", "report_bundle_ready"),
}


def _event_case(side: int) -> Column:
    out = None
    for kind, values in EVENT_STATUS.items():
        value = F.lit(values[side]).cast("string")
        out = F.when(F.col("event_type") == kind, value) if out is None else out.when(F.col("event_type") == kind, value)
    return out


def status_events(spark: SparkSession, sf: str, source: DataFrame | None = None) -> DataFrame:
    """Events as status patches of a run per user; failures carry an error text."""
    rows = source if source is not None else table(spark, sf, "events")
    return rows.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        _event_case(0).alias("status"), _event_case(1).alias("stage"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), (F.col("event_id") % 10).cast("string"))).alias("error"),
    )


def _event_sql(side: int) -> str:
    whens = " ".join(
        f"WHEN {quoted(k)} THEN {'NULL' if v[side] is None else quoted(v[side])}" for k, v in EVENT_STATUS.items()
    )
    return f"CASE event_type {whens} END"


EVENTS_SQL = f"""
SELECT user_id::VARCHAR AS run_id, ts, event_id, {_event_sql(0)} AS status, {_event_sql(1)} AS stage,
       CASE WHEN event_type = 'error' THEN 'E' || (event_id % 10) END AS error
FROM events"""


# --- crawled text from documents ---------------------------------------------------------

def crawled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as crawled pages: text = Markdown, first line = title, source = run."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("pos"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("markdown"),
        F.when(F.col("doc_id") % 4 != 0, "success").when(F.col("doc_id") % 8 == 0, "failed").otherwise("pending").alias("crawl_status"),
    )


CRAWLED_SQL = r"""
SELECT source AS run_id, doc_id AS pos, 'https://www.' || source || '.example.com/' || lang || '/' || doc_id AS url,
       split_part(text, chr(10), 1) AS title, text AS markdown,
       CASE WHEN doc_id % 4 <> 0 THEN 'success' WHEN doc_id % 8 = 0 THEN 'failed' ELSE 'pending' END AS crawl_status
FROM documents"""
