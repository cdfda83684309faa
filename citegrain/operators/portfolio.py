"""Query portfolios: normalisation, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citegrain.functions.text import clean_value, strip_ws, text_or_empty
from citegrain.operators.frames import ensure_columns

SCHEMA_VERSION = "brand_topic_query_portfolio.v1"
VERSION_PREFIX = "brand_topic_query_portfolio"

# Allowed stages and query types.
JOURNEY_STAGES = (
    "awareness", "consideration", "decision", "retention", "advocacy", "research", "comparison",
    "purchase", "post_purchase", "support", "loyalty",
)
QUERY_TYPES = (
    "branded", "non_branded", "competitor_comparison", "informational", "transactional",
    "navigational", "local", "long_tail",
)
MAX_QUERIES, MAX_TOPICS = 200, 30

QUERY_STRUCT = (
    "struct<query_id:string,query:string,topic:string,query_type:string,journey_stage:string,"
    "intent:string,priority:string,recommended_page_type:string>"
)
TOPIC_STRUCT = "struct<topic:string,name:string,description:string,rationale:string>"
PORTFOLIO_SCHEMA = (
    f"portfolio_id string, schema_version string, brand string, market string, domain string, "
    f"portfolio_source string, created_at_epoch bigint, topics array<{TOPIC_STRUCT}>, queries array<{QUERY_STRUCT}>"
)


def query_errors(query="query", stage="journey_stage", kind="query_type", index="pos") -> Column:
    """Error messages of one query row."""
    prefix = F.format_string("queries[%d]", F.col(index))
    stage_text, kind_text = strip_ws(text_or_empty(stage)), strip_ws(text_or_empty(kind))
    listed = lambda names: ", ".join(sorted(names))
    unknown = lambda field, value, names: F.when(
        (value != "") & ~F.lower(value).isin(*names),
        F.concat(prefix, F.lit(f": {field} '"), value, F.lit(f"' is not recognised (allowed: {listed(names)})")),
    )
    return F.array_compact(F.array(
        F.when(strip_ws(text_or_empty(query)) == "", F.concat(prefix, F.lit(": missing required field 'query'"))),
        unknown("journey_stage", stage_text, JOURNEY_STAGES),
        unknown("query_type", kind_text, QUERY_TYPES),
    ))


def topic_errors(topic="topic", name="name", index="pos") -> Column:
    prefix = F.format_string("topics[%d]", F.col(index))
    blank = (strip_ws(text_or_empty(topic)) == "") & (strip_ws(text_or_empty(name)) == "")
    return F.array_compact(F.array(F.when(blank, F.concat(prefix, F.lit(": missing required field 'topic' or 'name'")))))


def _first_positions(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.select(key, "pos", value.alias("_v")).where("_v != ''").groupBy(key, "_v").agg(
        F.min("pos").alias("_first"), F.count("*").alias("_n")
    )


def query_messages(queries: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """One row per problem: portfolio, position, severity, message (errors and duplicate warnings).

    Duplicates are found by counting first and joining only values that occur twice, so a
    value repeated very often never has its rows gathered in one place.
    """
    errors = queries.select(key, "pos", F.lit("error").alias("severity"), F.explode(query_errors()).alias("message"))

    def repeats(value: Column, label: str) -> DataFrame:
        valued = queries.withColumn("_v", value).where("_v != ''")
        twice = _first_positions(queries, key, value).where("_n > 1")
        hits = valued.join(twice, [key, "_v"]).where("pos > _first")
        text = F.concat(F.format_string("queries[%d]: ", F.col("pos")), F.lit(f"duplicate {label} '"), F.col("_v"), F.lit("'"))
        return hits.select(key, "pos", F.lit("warning").alias("severity"), text.alias("message"))

    ids = repeats(strip_ws(text_or_empty("query_id")), "query_id")
    texts = repeats(F.lower(strip_ws(text_or_empty("query"))), "query text")
    return errors.unionByName(ids).unionByName(texts)


def portfolio_verdicts(portfolios: DataFrame, topics: DataFrame, queries: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Per portfolio: valid, error and warning counts, statistics and the portfolio-level warnings.

    ``portfolios``: portfolio_id, schema_version, brand, market; ``topics``/``queries``: rows with
    pos. Individual messages stay rows (``query_messages``).
    """
    q_ids, q_texts = strip_ws(text_or_empty("query_id")), F.lower(strip_ws(text_or_empty("query")))
    per_query = queries.groupBy(key).agg(
        F.count("*").alias("query_count"), F.sum(F.size(query_errors())).alias("_query_errors")
    )
    distinct = lambda value, name: _first_positions(queries, key, value).groupBy(key).agg(
        F.count("*").alias(name), F.sum(F.col("_n") - 1).alias(f"_dup_{name}")
    )
    per_topic = topics.groupBy(key).agg(
        F.count("*").alias("topic_count"), F.sum(F.size(topic_errors())).alias("_topic_errors")
    )
    j = (
        portfolios.select(key, "schema_version", "brand", "market")
        .join(per_topic, key, "left").join(per_query, key, "left")
        .join(distinct(q_ids, "queries_with_ids"), key, "left")
        .join(distinct(q_texts, "unique_query_texts"), key, "left")
    ).na.fill(0)
    empty_topics, empty_queries = F.col("topic_count") == 0, F.col("query_count") == 0
    structural = empty_topics.cast("int") + empty_queries.cast("int")
    version = strip_ws(text_or_empty("schema_version"))
    blank = lambda c: strip_ws(text_or_empty(c)) == ""
    notes = F.array_compact(F.array(
        F.when((version != "") & ~version.startswith(VERSION_PREFIX),
               F.concat(F.lit("schema_version '"), version, F.lit(f"' does not match expected prefix '{VERSION_PREFIX}'"))),
        F.when(blank("brand"), "'brand' is missing or empty; it will be populated from the refresh request"),
        F.when(blank("market"), "'market' is missing or empty; it will be populated from the refresh request"),
        F.when(F.col("query_count") > MAX_QUERIES, F.concat(
            F.lit("Portfolio contains "), F.col("query_count").cast("string"),
            F.lit(f" queries; consider limiting to ≤{MAX_QUERIES} for optimal performance"))),
        F.when(F.col("topic_count") > MAX_TOPICS, F.concat(
            F.lit("Portfolio contains "), F.col("topic_count").cast("string"),
            F.lit(f" topics; consider limiting to ≤{MAX_TOPICS} for balanced coverage"))),
    ))
    shaped = structural == 0
    errors = F.when(shaped, F.col("_query_errors") + F.col("_topic_errors")).otherwise(structural)
    warnings = F.when(
        shaped, F.size("notes") + F.col("_dup_queries_with_ids") + F.col("_dup_unique_query_texts")
    ).otherwise(0)
    return j.withColumn("notes", F.when(shaped, notes).otherwise(F.array().cast("array<string>"))).select(
        key, (errors == 0).alias("valid"), errors.cast("bigint").alias("errors"), warnings.cast("bigint").alias("warnings"),
        "topic_count", "query_count", "queries_with_ids", "unique_query_texts", "notes",
    )


def numbered_id(index: Column) -> Column:
    return F.format_string("q%03d", index + 1)


def normalise_queries(queries: DataFrame, entities: bool = True) -> DataFrame:
    """Clean text fields and give ``q001``-style ids by position where the id is missing."""
    cleaned = {
        c: clean_value(c, entities=entities)
        for c in ("query", "topic", "journey_stage", "intent", "priority", "recommended_page_type")
        if c in queries.columns
    }
    return queries.withColumns(cleaned).withColumn(
        "query_id", F.coalesce(F.nullif(strip_ws(F.col("query_id")), F.lit("")), numbered_id(F.col("pos")))
    )


def is_valid_portfolio() -> Column:
    """The gate on ingest: known version, at least one query and one topic."""
    return (
        text_or_empty("schema_version").startswith(VERSION_PREFIX)
        & (F.coalesce(F.size("queries"), F.lit(0)) > 0) & (F.coalesce(F.size("topics"), F.lit(0)) > 0)
    )


def with_defaults(portfolios: DataFrame, source: str = "user_upload") -> DataFrame:
    """Version, source, and brand/market/domain from ``request_*`` columns where missing."""
    p = ensure_columns(portfolios, request_brand="string", request_market="string", request_domain="string",
                       portfolio_source="string", schema_version="string", domain="string")
    fill = lambda name: F.coalesce(F.when(strip_ws(text_or_empty(name)) != "", F.col(name)), F.col(f"request_{name}"))
    return p.withColumns({
        "schema_version": F.coalesce("schema_version", F.lit(SCHEMA_VERSION)),
        "portfolio_source": F.coalesce("portfolio_source", F.lit(source)),
        "brand": fill("brand"), "market": fill("market"), "domain": fill("domain"),
    }).drop("request_brand", "request_market", "request_domain")


def explode_portfolios(portfolios: DataFrame):
    """(topics, queries) as rows with positions."""
    topics = portfolios.select("portfolio_id", F.posexplode("topics").alias("pos", "t")).select("portfolio_id", "pos", "t.*")
    queries = portfolios.select("portfolio_id", F.posexplode("queries").alias("pos", "q")).select("portfolio_id", "pos", "q.*")
    return topics, queries


def template(spark: SparkSession, brand: str = "", market: str = "", domain: str = "") -> DataFrame:
    """One example portfolio that passes every check, to start an own one from."""
    name = brand or "YourBrand"
    topics = [
        {"topic": "Range and charging", "description": "How far and how fast"},
        {"topic": "Ownership costs", "description": "Price, finance and upkeep"},
    ]
    rows = (
        ("electric family cars compared", 0, "non_branded", "comparison", "medium"),
        (f"{name} range in winter", 0, "branded", "research", "high"),
        (f"{name} monthly payment", 1, "branded", "decision", "high"),
    )
    queries = [
        {"query_id": f"q{i:03d}", "query": text, "topic": topics[t]["topic"], "query_type": kind, "journey_stage": stage, "priority": prio}
        for i, (text, t, kind, stage, prio) in enumerate(rows, start=1)
    ]
    row = {
        "schema_version": SCHEMA_VERSION, "brand": name, "market": market or "YourMarket",
        "domain": domain or "https://www.yourbrand.example", "portfolio_source": "user_upload", "topics": topics, "queries": queries,
    }
    return spark.createDataFrame([row], PORTFOLIO_SCHEMA)
