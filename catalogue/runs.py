"""Registry, portfolio, status, JSON, export and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.base import (
    EVENTS_SQL, MANIFESTS_SQL, OWNED, READY_SQL, RECENCY_SQL, in_list, key_sql, manifests, query, quoted, status_events, table,
)
from catalogue.pages import ENRICHED_SQL, SPARSE_SQL, _sparse_pages
from catalogue.urls import AUTH
from catalogue.texts import compact_sql
from citegrain.functions import url as U
from citegrain.operators import hygiene as H, json_walks, merging, portfolio as V, registry as R, status as S
from citegrain.operators import crawl
from citegrain.session import shared_dir
from citegrain.sources import artifacts as A
from citegrain.sources import exports as E
from citegrain.sources import pages as P
from citegrain.sources import sitemaps as M
from citegrain.streaming import status as X

# --- registry -----------------------------------------------------------------------------

KEYED_SQL = f"""
SELECT *, {key_sql('brand')} AS bk, {key_sql('market')} AS mk, {key_sql('domain')} AS dk, {RECENCY_SQL} AS rec FROM ({MANIFESTS_SQL}) WHERE {READY_SQL}"""
LATEST_SQL = f"""
SELECT bk AS brand_key, mk AS market_key, NULL::VARCHAR AS domain_key, arg_max(run_id, (rec, run_id)) AS run_id, max(rec) AS recency, 'market' AS level FROM ({KEYED_SQL}) GROUP BY 1, 2
UNION ALL SELECT bk, mk, dk, arg_max(run_id, (rec, run_id)), max(rec), 'domain' FROM ({KEYED_SQL}) WHERE dk <> '' GROUP BY 1, 2, 3"""


@query(f"SELECT run_id, {READY_SQL} AS report_ready FROM ({MANIFESTS_SQL})")
def report_ready(spark, sf):
    return manifests(spark, sf).select("run_id", R.is_report_ready().alias("report_ready"))


@query(f"SELECT brand_key, market_key, coalesce(domain_key, '*') AS domain_key, run_id, recency, level FROM ({LATEST_SQL})")
def latest_run(spark, sf):
    return R.latest_successful(manifests(spark, sf)).withColumn("domain_key", F.coalesce("domain_key", F.lit("*")))


@query(f"SELECT run_id, brand, market FROM ({KEYED_SQL}) WHERE bk = 'building' AND mk = 'nation_3' AND (dk = '' OR dk = 'www.c1.example.com') ORDER BY rec DESC, run_id DESC LIMIT 1")
def scan_latest(spark, sf):
    return R.scan_latest(manifests(spark, sf), "Building", "Nation 3", "https://www.c1.example.com").select("run_id", "brand", "market")


@query(f"""
WITH l AS ({LATEST_SQL.replace(READY_SQL, READY_SQL + ' AND has_payload')}), q AS (SELECT c_custkey AS request_id, {key_sql('c_mktsegment')} AS b, {key_sql("'Nation ' || c_nationkey")} AS m,
   CASE WHEN c_custkey % 2 = 0 THEN 'www.c' || (c_custkey % 4 // 2) || '.example.com' ELSE '' END AS d FROM customer)
SELECT q.request_id, coalesce(x.run_id, y.run_id) AS run_id, CASE WHEN x.run_id IS NOT NULL THEN 'domain' ELSE 'market' END AS matched_by
FROM q LEFT JOIN l x ON x.level = 'domain' AND x.brand_key = b AND x.market_key = m AND x.domain_key = d
LEFT JOIN l y ON y.level = 'market' AND y.brand_key = b AND y.market_key = m WHERE coalesce(x.run_id, y.run_id) IS NOT NULL""")
def latest_with_fallback(spark, sf):
    n = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(
        n.alias("request_id"), F.col("c_mktsegment").alias("brand"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("market"),
        F.when(n % 2 == 0, F.concat(F.lit("https://www.c"), F.floor(n % 4 / 2).cast("string"), F.lit(".example.com"))).otherwise("").alias("domain"))
    return R.resolve_latest(requests, manifests(spark, sf))


@query(f"""
WITH s AS (SELECT o_orderkey::VARCHAR AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'late_stage' ELSE '' END AS stage, o_orderkey % 50 AS query_count FROM orders)
SELECT m.run_id, brand, market, coalesce(nullif(s.stage, ''), m.stage) AS stage, coalesce(nullif(s.query_count, 0), -1) AS query_count, rec AS newest, brand || ' / ' || market || ' — ' || m.run_id AS label
FROM ({KEYED_SQL}) m LEFT JOIN s USING (run_id) WHERE bk = 'machinery' ORDER BY rec DESC, run_id DESC LIMIT 500""")
def run_history(spark, sf):
    statuses = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "late_stage").otherwise("").alias("stage"),
        (F.col("o_orderkey") % 50).alias("query_count"))
    h = R.history(manifests(spark, sf), statuses, brand="MACHINERY", market="all", limit=500)
    return h.select("run_id", "brand", "market", "stage", F.coalesce("query_count", F.lit(-1)).alias("query_count"),
                    F.coalesce("completed_at_epoch", "created_at_epoch").alias("newest"), "label")


ARTIFACTS = ("audit_context", "evidence_scope", "google_ai_mode_compact", "owned_pages_full", "external_pages_full", "visibility_matrix", "source_classification")


def artifact_rows(spark, sf):
    """Line items as stored artifacts of a run: the line number picks the artifact."""
    name = F.element_at(F.array(*[F.lit(a) for a in ARTIFACTS]), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), name.alias("artifact"), F.col("l_partkey").alias("payload"), "l_suppkey")


@query(f"""
WITH p AS (SELECT l_orderkey::VARCHAR AS run_id, list_distinct(list(([{in_list(ARTIFACTS)}])[l_linenumber])) AS have FROM lineitem GROUP BY 1),
m AS (SELECT run_id, list_filter([{in_list(sorted(ARTIFACTS))}], lambda a: NOT list_contains(have, a)) AS miss FROM p)
SELECT run_id, array_to_string(miss, ',') AS missing, CASE WHEN len(miss) = 0 THEN 'ready' ELSE 'incomplete' END AS status FROM m""")
def completeness(spark, sf):
    return R.completeness(artifact_rows(spark, sf)).withColumn("missing", F.array_join("missing", ","))



@query("SELECT o_orderkey AS run_id, o_orderkey % 2 = 0 OR o_custkey % 3 = 0 AS recognised FROM orders")
def report_payload(spark, sf):
    sizes = {"query_workbench": F.when(F.col("o_orderkey") % 2 == 0, 3), "owned_pages": F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0), "tiles": F.lit(0)}
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), R.has_report_payload(sizes).alias("recognised"))


@query("""
WITH q AS (SELECT c_mktsegment AS run_id, count(*) AS query_count FROM customer GROUP BY 1),
p AS (SELECT c_mktsegment AS run_id, count(*) AS owned_pages_scoreable, count(*) FILTER (c_custkey % 3 = 0) AS owned_query_mapped_unique FROM customer WHERE c_acctbal > 0 GROUP BY 1),
c AS (SELECT c_mktsegment AS run_id, count(*) AS source_citation_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT run_id, coalesce(query_count, 0) AS query_count, coalesce(owned_pages_scoreable, 0) AS owned_pages_scoreable,
       coalesce(owned_query_mapped_unique, 0) AS owned_query_mapped_unique, coalesce(source_citation_count, 0) AS source_citation_count
FROM q FULL JOIN p USING (run_id) FULL JOIN c USING (run_id)""")
def run_manifest(spark, sf):
    c = table(spark, sf, "customer").withColumn("run_id", F.col("c_mktsegment"))
    rows = c.where("c_acctbal > 0").withColumn("query_mapped", F.col("c_custkey") % 3 == 0)
    cites = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return R.manifest_counts(c, rows, cites)


@query("SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 0 THEN 'kept' ELSE 'delete' END AS action FROM orders WHERE o_orderstatus <> 'O'")
def retention_plan(spark, sf):
    o = table(spark, sf, "orders").withColumn("run_id", F.col("o_orderkey"))
    return R.retention_plan(o, o.where("o_custkey % 4 = 0"), o.where("o_orderstatus <> 'O'"))


@query("SELECT l_orderkey AS run_id, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def deleted_runs(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("run_id", F.col("l_orderkey"))
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("run_id"))
    return R.without_runs(li, gone).groupBy("run_id").agg(F.count("*").alias("rows"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey ELSE 'e' || c_custkey END AS brand,
       CASE WHEN c_custkey % 5 = 0 THEN 'top' ELSE coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'mm' END, 'em') END AS market FROM customer""")
def bundle_metadata(spark, sf):
    n = F.col("c_custkey")
    text = lambda letter: F.concat(F.lit(letter), n.cast("string"))
    b = table(spark, sf, "customer").select(
        "c_custkey", n.cast("string").alias("run_id"), F.when(n % 2 == 0, F.col("c_name")).otherwise("").alias("brand"),
        F.when(n % 5 == 0, "top").alias("market"), F.lit(None).cast("string").alias("domain"),
        F.struct(F.lit("").alias("run_id"), F.when(n % 3 == 0, text("m")).alias("brand"), F.when(n % 3 == 0, "mm").alias("market"), F.lit("d").alias("domain")).alias("meta"),
        F.struct(text("e").alias("brand"), F.lit("em").alias("market")).alias("executive"))
    return R.with_bundle_metadata(b).select("c_custkey", "brand", "market")


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'registry' WHEN o_orderkey % 3 = 0 THEN 'run_copy' ELSE '-' END AS found_in, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'copy' ELSE '-' END AS status FROM orders")
def status_lookup(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    out = R.lookup_status(o.select("run_id"), o.where("run_id % 2 = 0"), o.where("run_id % 3 = 0").withColumn("status", F.lit("copy")))
    return out.na.fill("-")


CONFIG_SQL = f"""
SELECT {key_sql('c_mktsegment')} || '__' || {key_sql("'Nation ' || c_nationkey")} AS k, c_custkey, c_mktsegment, 'Nation ' || c_nationkey AS market, c_name FROM customer"""


def _config_saves(spark, sf):
    return table(spark, sf, "customer").select(
        F.format_string("cfg%09d", F.col("c_custkey")).alias("config_id"), F.col("c_mktsegment").alias("brand"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("market"), F.col("c_name").alias("language"), F.col("c_custkey").alias("updated_at"))


@query(f"""
SELECT k AS config_key, printf('cfg%09d', min(c_custkey)) AS config_id, arg_max(c_mktsegment, c_custkey) AS brand, arg_max(market, c_custkey) AS market, arg_max(c_name, c_custkey) AS language,
       min(c_custkey) AS created_at, max(c_custkey) AS updated_at FROM ({CONFIG_SQL}) GROUP BY 1""")
def config_upsert(spark, sf):
    return R.current_configs(_config_saves(spark, sf), ("language",))


@query(f"SELECT k AS config_key, max(c_mktsegment) AS brand, max(market) AS market FROM ({CONFIG_SQL}) WHERE c_mktsegment = 'HOUSEHOLD' AND market <> 'Nation 7' GROUP BY 1")
def config_list(spark, sf):
    configs = R.current_configs(_config_saves(spark, sf), ("language",))
    removed = _config_saves(spark, sf).where("market = 'Nation 7'")
    return R.list_configs(R.delete_configs(configs, removed), brand="household").select("config_key", "brand", "market")


def _portfolios(spark, sf):
    n = F.col("o_orderkey")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.concat(F.lit("p"), F.lpad(n.cast("string"), 9, "0")).alias("portfolio_id"), F.col("c_mktsegment").alias("brand"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("market"),
        F.concat(F.lit("d"), (n % 4).cast("string")).alias("domain"), (n % 5).alias("query_count"), (n % 3).alias("topic_count"),
        F.when(n % 17 != 0, (n * 7919) % 100000).alias("created_at_epoch"))


PORTFOLIOS_SQL = """
SELECT 'p' || lpad(o_orderkey::VARCHAR, 9, '0') AS portfolio_id, c_mktsegment AS brand, 'Nation ' || c_nationkey AS market, 'd' || (o_orderkey % 4) AS domain, o_orderkey % 5 AS nq, o_orderkey % 3 AS nt,
       CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 7919) % 100000 ELSE 0 END AS created FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(f"""
WITH p AS (SELECT * FROM ({PORTFOLIOS_SQL}) WHERE nq > 0 AND nt > 0 AND (created = 0 OR created >= 20000)),
q AS (SELECT c_custkey AS request_id, c_mktsegment AS brand, 'Nation ' || c_nationkey AS market, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'd' || (c_custkey % 6) END AS want FROM customer),
r AS (SELECT request_id, portfolio_id, created, domain = want AS hit, row_number() OVER (PARTITION BY request_id ORDER BY (domain = want) DESC, created DESC, portfolio_id DESC) AS rn FROM q JOIN p USING (brand, market))
SELECT request_id, portfolio_id, created AS created_at_epoch, hit AS domain_match FROM r WHERE rn = 1""")
def recent_portfolio(spark, sf):
    n = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(
        n.alias("request_id"), F.col("c_mktsegment").alias("brand"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("market"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("d"), (n % 6).cast("string"))).alias("domain"))
    return R.recent_portfolios(_portfolios(spark, sf), requests, 20000)


@query(f"""
WITH k AS (SELECT lower(brand) || '__' || replace(lower(market), ' ', '_') AS latest_key, portfolio_id, created FROM ({PORTFOLIOS_SQL})
  UNION ALL SELECT lower(brand) || '__' || replace(lower(market), ' ', '_') || '__' || domain, portfolio_id, created FROM ({PORTFOLIOS_SQL}))
SELECT latest_key, arg_max(portfolio_id, (created, portfolio_id)) AS portfolio_id, max(created) AS created_at_epoch FROM k GROUP BY 1""")
def latest_portfolios(spark, sf):
    return R.latest_portfolios(_portfolios(spark, sf).na.fill({"created_at_epoch": 0}))


@query(f"""
WITH a AS (SELECT l_orderkey::VARCHAR AS run_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, l_linenumber ORDER BY CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 1 END, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM a)
SELECT run_id, l_linenumber, l_partkey, l_suppkey FROM r WHERE rn = 1""")
def keep_completed(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), "l_linenumber", "l_partkey", "l_suppkey",
        F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("pos"))
    kept = merging.keep_richer(li, ["run_id", "l_linenumber"], F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(1))
    return kept.select("run_id", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT 'target' AS run_id, ([{in_list(ARTIFACTS)}])[l_linenumber] AS artifact, l_partkey AS payload, count(*) AS n FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber NOT IN (4, 5) GROUP BY ALL")
def carry_forward(spark, sf):
    a = artifact_rows(spark, sf)
    first = table(spark, sf, "lineitem").agg(F.min("l_orderkey").cast("string")).first()[0]
    return A.carry_forward(a, first, "target").groupBy("run_id", "artifact", "payload").agg(F.count("*").alias("n"))


# --- portfolios ---------------------------------------------------------------------------

STAGES = (*V.JOURNEY_STAGES[:4], "Purchase", "wandering", "")
KINDS = ("branded", "Local", "weird", "")


def portfolio_rows(spark, sf):
    """User turns as portfolio queries with some faults; one portfolio per conversation modulo 7."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    n = F.col("conv_id")
    return c.select(
        F.concat(F.lit("pf"), (n % 7).cast("string")).alias("portfolio_id"), (n * 100 + F.col("turn")).cast("int").alias("pos"),
        F.when(n % 11 == 0, " ").otherwise(F.col("text")).alias("query"), pick(STAGES, n).alias("journey_stage"),
        pick(KINDS, n + F.col("turn")).alias("query_type"),
        F.when(n % 3 != 0, F.concat(F.lit("id"), (n % 40).cast("string"))).alias("query_id"))


PF_SQL = f"""
SELECT 'pf' || (conv_id % 7) AS portfolio_id, conv_id * 100 + turn AS pos, CASE WHEN conv_id % 11 = 0 THEN ' ' ELSE text END AS query,
       ([{in_list(STAGES)}])[conv_id % {len(STAGES)} + 1] AS stage, ([{in_list(KINDS)}])[(conv_id + turn) % {len(KINDS)} + 1] AS kind,
       CASE WHEN conv_id % 3 <> 0 THEN 'id' || (conv_id % 40) END AS query_id FROM conversations WHERE role = 'user'"""
_allowed = lambda names: ", ".join(sorted(names))
MESSAGES_SQL = f"""
t AS (SELECT *, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS qt FROM ({PF_SQL})),
e AS (
  SELECT portfolio_id, pos, 'error' AS severity, 'queries[' || pos || ']: missing required field ''query''' AS message FROM t WHERE qt = ''
  UNION ALL SELECT portfolio_id, pos, 'error', 'queries[' || pos || ']: journey_stage ''' || stage || ''' is not recognised (allowed: {_allowed(V.JOURNEY_STAGES)})' FROM t WHERE stage = 'wandering'
  UNION ALL SELECT portfolio_id, pos, 'error', 'queries[' || pos || ']: query_type ''' || kind || ''' is not recognised (allowed: {_allowed(V.QUERY_TYPES)})' FROM t WHERE kind = 'weird'),
w AS (
  SELECT portfolio_id, pos, 'warning' AS severity, 'queries[' || pos || ']: duplicate query_id ''' || query_id || '''' AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, query_id ORDER BY pos) AS rn FROM t WHERE query_id IS NOT NULL) WHERE rn > 1
  UNION ALL SELECT portfolio_id, pos, 'warning', 'queries[' || pos || ']: duplicate query text ''' || lower(qt) || ''''
  FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, lower(qt) ORDER BY pos) AS rn FROM t WHERE qt <> '') WHERE rn > 1)"""


@query(f"WITH {MESSAGES_SQL} SELECT * FROM e UNION ALL SELECT * FROM w")
def portfolio_messages(spark, sf):
    return V.query_messages(portfolio_rows(spark, sf))


@query(f"""
WITH {MESSAGES_SQL}, ec AS (SELECT portfolio_id, count(*) AS n FROM e GROUP BY 1), wc AS (SELECT portfolio_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT portfolio_id, count(*) AS query_count, count(DISTINCT query_id) AS queries_with_ids, count(DISTINCT CASE WHEN qt <> '' THEN lower(qt) END) AS unique_query_texts FROM t GROUP BY 1)
SELECT portfolio_id, coalesce(ec.n, 0) = 0 AS valid, coalesce(ec.n, 0) AS errors,
       coalesce(wc.n, 0) + (portfolio_id = 'pf1')::INT + (portfolio_id = 'pf2')::INT + (query_count > 200)::INT AS warnings, 2 AS topic_count, query_count, queries_with_ids, unique_query_texts,
       (portfolio_id = 'pf1')::INT + (portfolio_id = 'pf2')::INT + (query_count > 200)::INT AS notes
FROM s LEFT JOIN ec USING (portfolio_id) LEFT JOIN wc USING (portfolio_id)""")
def portfolio_validation(spark, sf):
    q = portfolio_rows(spark, sf)
    heads = q.select("portfolio_id").distinct().select(
        "portfolio_id", F.when(F.col("portfolio_id") == "pf1", "other.v9").otherwise(V.SCHEMA_VERSION).alias("schema_version"),
        F.when(F.col("portfolio_id") == "pf2", " ").otherwise("b").alias("brand"), F.lit("m").alias("market"))
    topics = heads.select("portfolio_id", F.posexplode(F.array(F.lit("EV"), F.lit("Safety"))).alias("pos", "topic")).withColumn("name", F.lit(None).cast("string"))
    return V.portfolio_verdicts(heads, topics, q).withColumn("notes", F.size("notes"))


@query(f"""
SELECT portfolio_id, pos, coalesce(query_id, CASE WHEN pos + 1 < 1000 THEN printf('q%03d', pos + 1) ELSE 'q' || (pos + 1) END) AS query_id, {compact_sql('query')} AS query FROM ({PF_SQL})""")
def portfolio_normalise(spark, sf):
    return V.normalise_queries(portfolio_rows(spark, sf)).select("portfolio_id", "pos", "query_id", "query")


@query("""
SELECT item_id AS path, 'b' || (item_id % 3) AS brand, 2 AS queries, 1 AS topics, 'q & a ' || item_id AS first_query FROM benchmark WHERE item_id % 6 <> 5""")
def portfolio_unwrap(spark, sf):
    n = F.col("item_id")
    q = lambda text: F.to_json(F.struct(text.alias("query"), F.lit("EV").alias("topic")))
    version = F.when(n % 6 == 5, "other.v1").otherwise("brand_topic_query_portfolio.v1")
    inner = F.concat(
        F.lit('{"schema_version":"'), version, F.lit('","brand":"b'), (n % 3).cast("string"), F.lit('","topics":["EV"],"queries":['),
        q(F.concat(F.lit("q &amp; a "), n.cast("string"))), F.lit(',"plain text query"]}'))
    as_text = F.regexp_extract(F.to_json(F.struct(inner.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    doc = (
        F.when(n % 6 == 0, inner).when(n % 6 == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```")))
        .when(n % 6 == 2, F.concat(F.lit('{"data":{"result":{"response":'), as_text, F.lit("}}}")))
        .when(n % 6 == 3, F.concat(F.lit('{"id":1,"portfolio":'), inner, F.lit("}")))
        .when(n % 6 == 4, F.concat(F.lit("Here it is: "), inner, F.lit(" done"))).otherwise(inner))
    docs = table(spark, sf, "benchmark").select(n.alias("path"), doc.alias("value"))
    return json_walks.unwrap_portfolios(docs).select(
        "path", "brand", F.size("queries").alias("queries"), F.size("topics").alias("topics"), F.col("queries")[0]["query"].alias("first_query"))


# --- status -------------------------------------------------------------------------------

LAST = lambda c: f"arg_max({c}, (ts, event_id)) FILTER ({c} IS NOT NULL)"
FOLD_SQL = f"""
SELECT run_id, {LAST('status')} AS status, {LAST('stage')} AS stage, {LAST('error')} AS error, epoch_us(max(ts)) AS updated_us,
       epoch_us(min(ts) FILTER (status = 'completed')) AS completed_us, epoch_us(min(ts) FILTER (status = 'failed')) AS failed_us,
       epoch_us(min(ts) FILTER (status IN ('accepted', 'running'))) AS started_us FROM ({EVENTS_SQL}) GROUP BY 1"""


def _folded(events):
    e = events.withColumn("ord", F.struct("ts", "event_id"))
    return S.fold_status(e, columns=("status", "stage", "error"))


def _shown(f):
    return f.select("run_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("status", "stage", "error")],
                    *[F.coalesce(F.unix_micros(c), F.lit(-1)).alias(n) for c, n in (
                        ("updated_at", "updated_us"), ("completed_at", "completed_us"), ("failed_at", "failed_us"), ("started_at", "started_us"))])


SHOWN_SQL = f"SELECT run_id, coalesce(status, '-') AS status, coalesce(stage, '-') AS stage, coalesce(error, '-') AS error, coalesce(updated_us, -1) AS updated_us, coalesce(completed_us, -1) AS completed_us, coalesce(failed_us, -1) AS failed_us, coalesce(started_us, -1) AS started_us FROM ({FOLD_SQL})"


@query(SHOWN_SQL)
def status_fold(spark, sf):
    return _shown(_folded(status_events(spark, sf)))


@query(f"""
WITH e AS (SELECT event_id % 500 AS job_id, value, ts, event_id FROM events)
SELECT job_id, round(arg_max(value, (ts, event_id)) * 100)::BIGINT AS progress, epoch_us(max(ts)) AS updated_us FROM e GROUP BY 1""")
def job_progress(spark, sf):
    e = table(spark, sf, "events").select(
        (F.col("event_id") % 500).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.lit("running").alias("status"),
        F.struct("ts", "event_id").alias("ord"))
    f = S.fold_status(e, key="job_id", columns=("value", "status"))
    return f.select("job_id", F.round(F.col("value") * 100).cast("bigint").alias("progress"), F.unix_micros("updated_at").alias("updated_us"))


# Without the error text a run may be active again; both forms are listed.
ACTIVE_SQL = f"""
n AS (SELECT epoch_us(max(ts)) // 1000000 AS now FROM events),
f AS (SELECT *, updated_us // 1000000 AS up FROM ({FOLD_SQL})),
a AS (SELECT f.*, CASE WHEN status IN ('completed', 'failed') THEN false WHEN stage = 'report_bundle_ready' THEN false
   WHEN now - up > CASE WHEN stage LIKE 'auditor%' OR stage = 'evidence_ready' THEN 86400 * 2 ELSE 86400 END THEN false
   WHEN status IN ('accepted', 'running') THEN true ELSE false END AS open, error IS NOT NULL AS err FROM f, n)"""


def _decided(spark, sf):
    events = status_events(spark, sf)
    folded = _folded(events).withColumn("updated_at_epoch", F.floor(F.unix_micros("updated_at") / 1000000).cast("bigint"))
    # one number, computed once by a tiny aggregate
    now = events.agg(F.floor(F.unix_micros(F.max("ts")) / 1000000).cast("bigint")).first()[0]
    columns = [c for c in folded.columns if c != "error"]
    day = 86400
    return folded.withColumns({
        "active_without_error": S.is_active(columns, F.lit(now), stale_seconds=day, auditor_stale_seconds=2 * day),
        "active": S.is_active(folded.columns, F.lit(now), stale_seconds=day, auditor_stale_seconds=2 * day),
    })


@query(f"WITH {ACTIVE_SQL} SELECT run_id, open AS active_without_error, open AND NOT err AS active FROM a")
def active_runs(spark, sf):
    return _decided(spark, sf).select("run_id", "active_without_error", "active")


@query(f"WITH {ACTIVE_SQL} SELECT run_id, up AS updated_at_epoch FROM a ORDER BY up DESC, run_id DESC LIMIT 1000")
def status_listing(spark, sf):
    return S.listing(_decided(spark, sf), 1000).select("run_id", "updated_at_epoch")


REQUESTS_SQL = f"""
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE {key_sql('c_mktsegment')} END AS b, CASE WHEN c_custkey % 5 = 4 THEN '' ELSE {key_sql("'Nation ' || c_nationkey")} END AS m,
   CASE WHEN c_custkey % 2 = 0 THEN 'www.c' || (c_custkey % 4 // 2) || '.example.com' ELSE '' END AS d FROM customer"""


@query(f"""
WITH q AS ({REQUESTS_SQL}), k AS (SELECT DISTINCT b, m, d FROM q),
s AS (SELECT *, {key_sql('brand')} AS bk, {key_sql('market')} AS mk, {key_sql('domain')} AS dk, coalesce(completed_at_epoch, created_at_epoch) AS up, {READY_SQL} AS ready,
   {RECENCY_SQL} AS rec FROM ({MANIFESTS_SQL})),
j AS (SELECT k.*, run_id, up, rec, ready, status = 'running' AS active FROM k JOIN s ON (b = '' OR b = bk) AND (m = '' OR m = mk) AND (d = '' OR dk = '' OR d = dk)),
r AS (SELECT *, row_number() OVER (PARTITION BY b, m, d ORDER BY up DESC, run_id DESC) AS n FROM j),
g AS (SELECT b, m, d, arg_max(run_id, (rec, run_id)) FILTER (ready) AS latest, arg_max(run_id, (up, run_id)) FILTER (active) AS active, string_agg(run_id, ' ' ORDER BY n) FILTER (n <= 20) AS runs
  FROM r GROUP BY 1, 2, 3)
SELECT request_id, coalesce(latest, '-') AS latest_successful_run_id, coalesce(active, '-') AS active_run_id, coalesce(runs, '') AS runs FROM q LEFT JOIN g USING (b, m, d)""")
def status_requests(spark, sf):
    """The status answer to a request of every customer: filters left open, runs of any domain, newest first."""
    n = F.col("c_custkey")
    requests = table(spark, sf, "customer").select(
        n.alias("request_id"), F.when(n % 4 != 3, F.col("c_mktsegment")).alias("brand"),
        F.when(n % 5 != 4, F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))).alias("market"),
        F.when(n % 2 == 0, F.concat(F.lit("https://www.c"), F.floor(n % 4 / 2).cast("string"), F.lit(".example.com"))).alias("domain"))
    runs = manifests(spark, sf)
    states = runs.withColumn("updated_at_epoch", F.coalesce("completed_at_epoch", "created_at_epoch"))
    states = states.withColumn("active", S.is_active(states.columns, F.col("updated_at_epoch")))
    found = S.requested(requests, states, runs)
    return found.select("request_id", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("latest_successful_run_id", "active_run_id")], F.array_join("runs", " ").alias("runs"))


@query(f"WITH {ACTIVE_SQL} SELECT status, arg_max(run_id, (up, run_id)) AS active_run_id FROM a WHERE open GROUP BY 1")
def first_active(spark, sf):
    return S.first_active(_decided(spark, sf).withColumn("active", F.col("active_without_error")), ("status",))


EPISODES_SQL = f"""
WITH g AS (SELECT run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ({EVENTS_SQL})),
s AS (SELECT run_id, ts, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT run_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 21600000000 AS ended, count(*) AS events FROM s GROUP BY run_id, n"""


@query(EPISODES_SQL)
def status_episodes(spark, sf):
    e = S.episodes(status_events(spark, sf), "6 hours")
    return e.select("run_id", F.unix_micros("episode_start").alias("started"), F.unix_micros("episode_end").alias("ended"), "events")


# --- JSON ---------------------------------------------------------------------------------

@query(rf"""
SELECT page_id, 0 AS pos, split_part(url, '#', 1) AS url, regexp_matches({AUTH}, '(^|\.)example\.(com|org)$') AS is_owned FROM pages
UNION ALL SELECT page_id, 1, 'https://ref.example.net/' || page_id, false FROM pages
UNION ALL SELECT page_id, 2, 'https://www.example.com/deep/' || page_id, true FROM pages""")
def json_urls(spark, sf):
    n = F.col("page_id").cast("string")
    doc = F.to_json(F.struct(
        F.col("url").alias("URL"), F.lit("https://ignored.example/").alias("link"),
        F.array(F.struct(F.concat(F.lit("https://ref.example.net/"), n, F.lit("#f")).alias("source_url"), F.lit(5).alias("n"))).alias("refs"),
        F.struct(F.struct(F.concat(F.lit("https://www.example.com/deep/"), n).alias("mapped_url"), F.lit("mailto:x").alias("page_url")).alias("inner")).alias("outer"),
    ))
    docs = table(spark, sf, "pages").select("page_id", doc.alias("doc"))
    found = json_walks.collect_urls(docs, "doc", ("page_id",))
    return found.select("page_id", "pos", "url", U.matches_any_domain(U.authority("url"), list(OWNED)).alias("is_owned"))


@query("""
SELECT item_id AS query_id, 3 AS refs, 'https://a.example/' || item_id || ' https://b.example/' || item_id || ' https://o.example/x' AS urls, '1 2 3' AS ranks,
       CASE WHEN item_id % 2 = 0 THEN 'Answer ' || item_id || ' in short' ELSE 'A longer snippet text number ' || item_id || ' of more than forty characters' END AS summary
FROM benchmark""")
def raw_answer_refs(spark, sf):
    n = F.col("item_id").cast("string")
    even = F.col("item_id") % 2 == 0
    raw = F.to_json(F.struct(
        F.when(even, F.struct(F.concat(F.lit("Answer "), n, F.lit("  in\nshort")).alias("summary"))).alias("ai_overview"),
        F.struct(F.array(
            F.struct(F.concat(F.lit("https://a.example/"), n).alias("link"), F.lit("T").alias("title")),
            F.struct(F.concat(F.lit("https://a.example/"), n).alias("link"), F.lit("dup").alias("title")),
            F.struct(F.concat(F.lit("https://b.example/"), n).alias("link"), F.lit("U").alias("title"))).alias("references")).alias("deep"),
        F.array(F.struct(F.lit("https://o.example/x").alias("link"), F.concat(
            F.lit("A longer snippet text number "), n, F.lit(" of more than forty characters")).alias("snippet"))).alias("organic_results"),
    ))
    docs = table(spark, sf, "benchmark").select(F.lit("r").alias("run_id"), F.col("item_id").alias("query_id"), F.col("text").alias("query"), raw.alias("raw"))
    a = json_walks.raw_answers(docs)
    join = lambda f: F.array_join(F.transform("references", lambda r: r[f].cast("string")), " ")
    return a.select("query_id", F.size("references").alias("refs"), join("url").alias("urls"), join("rank").alias("ranks"), F.col("answer_summary").alias("summary"))


# --- sitemaps -----------------------------------------------------------------------------

PAGES_PER_FILE, FILES_PER_INDEX = 50, 50


def landed_sitemaps(spark, sf):
    """Pages as landed sitemap files of at most 50 URLs, index files of at most 50 names, one broken file.

    Returns (files, candidates); page ids are unique, so id blocks bound every list.
    """
    p = table(spark, sf, "pages").select(U.site_domain(U.host("url")).alias("site"), "url", "page_id")
    loc = lambda c: F.concat(F.lit("<loc> "), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"))
    block = F.floor(F.col("page_id") / PAGES_PER_FILE)
    name = lambda kind, n: F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{kind}-"), n.cast("string"), F.lit(".xml?v=1"))
    chunks = p.groupBy("site", block.alias("n")).agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("u"))
    files = chunks.select("site", name("pages", F.col("n")).alias("sitemap_url"), F.concat(
        F.lit("<urlset>"), F.array_join(F.transform("u", lambda x: F.concat(F.lit("<url>"), loc(x["url"]), F.lit("</url>"))), ""), F.lit("</urlset>")).alias("content"))
    indexes = p.select("site", block.alias("n")).distinct().groupBy("site", F.floor(F.col("n") / FILES_PER_INDEX).alias("i")).agg(
        F.array_sort(F.collect_set("n")).alias("l"))
    index_files = indexes.select("site", name("index", F.col("i")).alias("sitemap_url"), F.concat(
        F.lit("<sitemapindex>"), F.array_join(F.transform("l", lambda n: F.concat(F.lit("<sitemap>"), loc(name("pages", n)), F.lit("</sitemap>"))), ""),
        F.lit("</sitemapindex>")).alias("content"))
    broken = p.select("site").distinct().select("site", name("broken", F.lit(0)).alias("sitemap_url"), F.lit("<urlset><url>").alias("content"))
    candidates = broken.select("site", F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos")).alias("order"), "sitemap_url").unionByName(
        indexes.select("site", F.struct(F.lit(1).alias("part"), F.col("i").alias("pos")).alias("order"), name("index", F.col("i")).alias("sitemap_url")))
    return files.unionByName(index_files).unionByName(broken), candidates


SITE_PAGES = rf"SELECT array_to_string(string_split({AUTH}, '.')[-2:], '.') AS site, url, page_id FROM pages"


@query(f"WITH r AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id) AS pos, url FROM ({SITE_PAGES})) SELECT * FROM r")
def sitemap_read(spark, sf):
    files, candidates = landed_sitemaps(spark, sf)
    parsed = M.parse_sitemaps(files)
    return M.site_inventory(parsed, M.read_order(parsed, candidates))[0]


@query(rf"""
WITH p AS ({SITE_PAGES}), b AS (SELECT site, page_id // {PAGES_PER_FILE} AS n, count(*) AS c FROM p GROUP BY 1, 2),
f AS (SELECT DISTINCT site, 0 AS level, 0::BIGINT AS o, 'broken' AS kind, 'error' AS status, 0::BIGINT AS locs, 0::BIGINT AS urls FROM p
  UNION ALL SELECT site, 1, n // {FILES_PER_INDEX}, 'index', 'success', count(*), 0 FROM b GROUP BY 1, 3
  UNION ALL SELECT site, 2, n, 'pages', 'success', c, c FROM b)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY level, o) AS idx, 'https://' || site || '/' || kind || '-' || o || '.xml?v=1' AS sitemap_url, status, locs AS loc_count, urls AS url_count FROM f""")
def sitemap_stats(spark, sf):
    """Every sitemap file in the order of reading: whether it could be read, its entries and its pages."""
    files, candidates = landed_sitemaps(spark, sf)
    parsed = M.parse_sitemaps(files)
    return M.site_inventory(parsed, M.read_order(parsed, candidates))[1]


@query(rf"""
WITH p AS ({SITE_PAGES}), paths AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(path)})" for i, path in enumerate(U.FALLBACK_PATHS, 1))}) t(pos, path))
SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id) AS pos, url, false AS fallback_used FROM p WHERE site NOT LIKE '%.net'
UNION ALL SELECT site, pos, 'https://' || site || path, true FROM (SELECT DISTINCT site FROM p WHERE site LIKE '%.net'), paths""")
def sitemap_fallback(spark, sf):
    """Pages of every site; those whose sitemap files cannot be read get the well-known pages."""
    files, candidates = landed_sitemaps(spark, sf)
    cut = F.when(F.col("site").endswith(".net"), F.expr("left(content, length(content) - 4)")).otherwise(F.col("content"))
    parsed = M.parse_sitemaps(files.withColumn("content", cut))
    sites = candidates.select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("domain")).distinct()
    return M.with_fallback(M.site_inventory(parsed, M.read_order(parsed, candidates))[0], sites)


@query(rf"""
WITH s AS (SELECT DISTINCT array_to_string(string_split({AUTH}, '.')[-2:], '.') AS site FROM pages)
SELECT site, 'https://maps.' || site || '/a:b.xml' AS sitemap_url, 1 AS part, 1 AS pos FROM s
UNION ALL SELECT site, 'https://www.' || site || '/sitemap.xml', 2, 0 FROM s UNION ALL SELECT site, 'https://www.' || site || '/sitemap_index.xml', 2, 1 FROM s
UNION ALL SELECT site, 'https://www.' || site || '/sitemap-index.xml', 2, 2 FROM s UNION ALL SELECT site, 'https://www.' || site || '/sitemap/sitemap.xml', 2, 3 FROM s
UNION ALL SELECT site, 'https://www.' || site || '/index.pages-sitemap.xml', 2, 4 FROM s
UNION ALL SELECT site, 'https://' || w || '.' || site || p, 2, o FROM s, (VALUES ('www3', '/sitemap.xml', 5), ('www3', '/sitemap_index.xml', 6), ('www3', '/sitemap-index.xml', 7),
  ('www3', '/sitemap/sitemap.xml', 8), ('www3', '/index.pages-sitemap.xml', 9), ('www2', '/sitemap.xml', 10), ('www2', '/sitemap_index.xml', 11), ('www2', '/sitemap-index.xml', 12),
  ('www2', '/sitemap/sitemap.xml', 13), ('www2', '/index.pages-sitemap.xml', 14)) v(w, p, o)""")
def robots_read(spark, sf):
    sites = table(spark, sf, "pages").select(U.site_domain(U.authority("url")).alias("site")).distinct()
    robots = M.robots_sitemaps(sites.select("site", F.concat(
        F.lit("User-agent: *\nSITEMAP:  https://maps."), "site", F.lit("/a:b.xml\r\nsitemap:\nDisallow: /sitemap: x")).alias("content")))
    rows = sites.select("site", F.concat(F.lit("https://www."), "site", F.lit("/")).alias("domain"), F.lit(None).cast("string").alias("explicit_sitemap_url"))
    return M.sitemap_candidates(rows, robots).select("site", "sitemap_url", "order.part", "order.pos")


# --- exports ------------------------------------------------------------------------------

@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL}
SELECT run_id, pos, url, title_len, md5(CASE WHEN len(txt) > 8000 THEN regexp_replace(left(txt, 8000), '\s+$', '') || chr(10) || '...[truncated]' ELSE txt12 END) AS extract,
       words AS word_count FROM (SELECT *, left(txt, 12000) AS txt12, 0 AS title_len FROM c)""")
def compact_export(spark, sf):
    p = _sparse_pages(spark, sf).select("run_id", "pos", "url", "markdown", "snippet", "crawl_status")
    x = E.slim_pages(p, external=True, keys=("run_id", "pos"))
    return x.select("run_id", "pos", "url", F.lit(0).alias("title_len"), F.md5("content_extract").alias("extract"), "word_count")


@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL}, o AS (SELECT run_id, count(*) AS owned_pages, count(*) FILTER (status = 'success' AND words >= 20) AS owned_pages_scoreable FROM c WHERE pos % 2 = 0 GROUP BY 1),
x AS (SELECT run_id, count(*) AS external_pages, count(*) FILTER (status = 'success' AND words >= 20) AS external_pages_scoreable FROM c WHERE pos % 2 = 1 GROUP BY 1),
f AS (SELECT run_id, least(100, count(*)) AS external_failed_sources FROM c WHERE status = 'failed' GROUP BY 1)
SELECT run_id, coalesce(owned_pages, 0) AS owned_pages, coalesce(owned_pages_scoreable, 0) AS owned_pages_scoreable, coalesce(external_pages, 0) AS external_pages,
       coalesce(external_pages_scoreable, 0) AS external_pages_scoreable, coalesce(external_failed_sources, 0) AS external_failed_sources
FROM o FULL JOIN x USING (run_id) FULL JOIN f USING (run_id)""")
def export_counts(spark, sf):
    p = _sparse_pages(spark, sf).drop("status_code", "final_url")
    owned = E.slim_pages(p.where("pos % 2 = 0"), keys=("run_id", "pos"))
    external = E.slim_pages(p.where("pos % 2 = 1"), external=True, keys=("run_id", "pos"))
    bad = crawl.enrich_pages(p).where("crawl_status = 'failed'").withColumn("error", F.lit("e"))
    return E.export_counts(owned, external, E.slim_failed(bad))


# --- files of runs ------------------------------------------------------------------------

STATUS_WORDS = ("available", "not_found", "not_requested", " Fetched ", "pending", "odd", "")
COUNTS = ("7", "", "12x", " 3", "0")


@query(f"""
WITH p AS (SELECT page_id, url, ['available', 'not found', 'not checked', 'available', 'not checked', 'none', 'not checked'][page_id % 7 + 1] AS word, page_id % 2 = 0 AS tried,
  page_id % 3 = 0 AS has_url, [{in_list(COUNTS)}][page_id % 5 + 1] AS c FROM pages)
SELECT page_id, CASE WHEN word = 'not checked' AND (tried OR has_url) THEN 'not found' WHEN word = 'none' THEN 'not checked' ELSE word END AS status, CASE WHEN has_url THEN url ELSE '-' END AS url,
       coalesce(CASE WHEN c = '' THEN 0 ELSE try_cast(c AS INTEGER) END, -1) AS sitemap_entries_count, CASE WHEN tried THEN page_id::INTEGER ELSE -1 END AS chars FROM p""")
def file_status_fields(spark, sf):
    """Status of a fetched file with its url, sitemap entries and size, from words and counts of any form."""
    n = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    p = table(spark, sf, "pages").select("page_id", H.file_record(
        pick(STATUS_WORDS), F.when(n % 3 == 0, F.col("url")).otherwise(""), F.when(n % 2 == 0, 2), None, pick(COUNTS), F.when(n % 2 == 0, n)).alias("f"))
    return p.select("page_id", "f.status", F.coalesce("f.url", F.lit("-")).alias("url"), *[F.coalesce(f"f.{c}", F.lit(-1)).alias(c) for c in ("sitemap_entries_count", "chars")])


PLACES = [(name, place, rank) for name, places in A.ARTIFACT_PATHS.items() for rank, place in enumerate(places)]


@query(f"""
WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {quoted(n)}, {quoted(place)}, {r})" for i, (n, place, r) in enumerate(PLACES))}) t(i, artifact, place, rank)),
f AS (SELECT 'r' || (o_orderkey % 997) AS run_id, artifact, '/data/runs/r' || (o_orderkey % 997) || '/' || place AS path, rank FROM orders JOIN c ON o_custkey % 9 = i)
SELECT run_id, artifact, arg_min(path, rank) AS path FROM f GROUP BY 1, 2""")
def artifact_locations(spark, sf):
    """Each artifact of a run at its first known place, from a listing of paths; other files are passed over."""
    places = F.array(*[F.lit(place) for _, place, _ in PLACES], F.lit("notes/other.json"))
    place = F.element_at(places, (F.col("o_custkey") % 9 + 1).cast("int"))
    run = F.concat(F.lit("r"), (F.col("o_orderkey") % 997).cast("string"))
    files = table(spark, sf, "orders").select(F.concat(F.lit("/data/runs/"), run, F.lit("/"), place).alias("path"))
    return A.locate_artifacts(files, "/data/runs")


@query("SELECT source AS run_id, doc_id, n_chars + (source < 'src1')::BIGINT AS n_chars FROM documents")
def artifact_write_twice(spark, sf):
    """Rows of all runs written, those of some runs written anew, twice: only these are replaced, and once."""
    folder = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select(F.col("source").alias("run_id"), "doc_id", "n_chars")
    A.write_artifact(rows, folder)
    for _ in range(2):
        A.write_artifact(rows.where("run_id < 'src1'").withColumn("n_chars", F.col("n_chars") + 1), folder)
    return spark.read.parquet(folder).select(F.col("run_id").cast("string").alias("run_id"), "doc_id", "n_chars")


@query("""
SELECT p.page_id, coalesce(len(d.text), 0) AS raw_markdown_chars,
       CASE WHEN p.page_id % 5 = 0 OR p.page_id % 3 = 2 THEN p.url WHEN p.page_id % 3 = 0 THEN 'https://r/' || p.page_id ELSE 'https://s/' || p.page_id END AS final_url,
       CASE WHEN p.page_id % 5 <> 0 THEN 'lang' || p.page_id % 5 ELSE '' END AS language, CASE WHEN p.page_id % 5 <> 0 THEN 1 ELSE 0 END AS links,
       p.page_id % 5 <> 0 AND p.page_id % 2 = 0 AS json_ld_present, md5(coalesce(d.text, '')) AS markdown_md5
FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id""")
def page_side_files(spark, sf):
    """Pages with the whole text and the manifest fields of their side files; every fifth manifest is missing."""
    n = F.col("page_id")
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), c.cast("string"))
    rows = table(spark, sf, "pages").select("page_id", "url", name("md", n).alias("markdown_file"), name("manifest", n).alias("manifest_file"))
    texts = table(spark, sf, "documents").select(name("md", F.col("doc_id")).alias("path"), F.col("text").alias("value"))
    fields = F.to_json(F.struct(
        F.struct(F.concat(F.lit("lang"), (n % 5).cast("string")).alias("language"), (n % 2 == 0).alias("json_ld_present")).alias("metadata"),
        F.array(F.struct("url", F.lit("t").alias("text"))).alias("links"),
        F.struct(F.when(n % 3 == 0, F.concat(F.lit("https://r/"), n.cast("string"))).otherwise("").alias("final_url")).alias("rendered_fetch"),
        F.struct(F.when(n % 3 == 1, F.concat(F.lit("https://s/"), n.cast("string"))).alias("final_url")).alias("static_fetch")))
    manifests = table(spark, sf, "pages").where("page_id % 5 <> 0").select(name("manifest", n).alias("path"), F.from_json(fields, P.MANIFEST_SCHEMA).alias("manifest"))
    found = P.with_side_files(rows, texts, manifests)
    return found.select("page_id", F.col("raw_markdown_chars"), "final_url", "language", F.size("links").alias("links"), "json_ld_present", F.md5("markdown").alias("markdown_md5"))


@query("""
SELECT c_custkey AS request_id, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS valid, CASE WHEN c_custkey % 4 = 1 THEN 'brand_topic_query_portfolio.v1' ELSE coalesce(
         CASE c_custkey % 4 WHEN 0 THEN 'other.v1' WHEN 2 THEN 'brand_topic_query_portfolio.v0' WHEN 3 THEN 'brand_topic_query_portfolio' END, '') END AS schema_version,
       CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE c_name END AS brand, 'user_upload' AS portfolio_source FROM customer""")
def portfolio_gate(spark, sf):
    """Uploaded portfolios with what is missing filled in, and whether they may be taken: version, queries, topics."""
    n = F.col("c_custkey")
    some = lambda test: F.when(test, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    version = F.when(n % 4 == 0, "other.v1").when(n % 4 == 2, "brand_topic_query_portfolio.v0").when(n % 4 == 3, "brand_topic_query_portfolio")
    p = table(spark, sf, "customer").select(
        n.alias("request_id"), version.alias("schema_version"), F.when(n % 6 != 0, F.col("c_name")).otherwise(F.when(n % 12 == 0, " ")).alias("brand"),
        F.lit("m").alias("market"), F.col("c_mktsegment").alias("request_brand"), some(n % 3 != 0).alias("queries"), some(n % 5 != 0).alias("topics"))
    filled = V.with_defaults(p)
    return filled.select("request_id", V.is_valid_portfolio().alias("valid"), "schema_version", "brand", "portfolio_source")


# --- streams ------------------------------------------------------------------------------

def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def run_stream(spark, stream, mode):
    """Run to the end of the input and read back what the sink holds, newest batch per key."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
    X.start(stream, sink, f"{base}/checkpoint", mode).awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*").drop("batch")


@query(SHOWN_SQL)
def status_stream(spark, sf):
    events = status_events(spark, sf, event_stream(spark, sf))
    out = run_stream(spark, X.status_stream(events, ("status", "stage", "error")), "update")
    latest = out.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "run_id"]), "_batch").alias("r"))
    return _shown(latest.select("run_id", "r.*"))


@query("""
SELECT event_type AS kind, count(*) AS pages_requested, count(*) FILTER (event_id % 5 <= 1) AS pages_collected, count(*) FILTER (event_id % 5 = 2) AS pages_weak,
       count(*) FILTER (event_id % 5 = 3) AS pages_failed FROM events GROUP BY 1""")
def partial_counts_stream(spark, sf):
    n = F.col("event_id") % 5
    rows = event_stream(spark, sf).select(
        F.col("event_type").alias("kind"), F.when(n <= 1, "success").when(n == 2, "partial").when(n == 3, "blocked").otherwise("pending").alias("crawl_status"))
    out = run_stream(spark, X.counters_stream(rows, "kind"), "update")
    latest = out.groupBy("kind").agg(F.max_by(F.struct(*[c for c in out.columns if c != "kind"]), "_batch").alias("r"))
    return latest.select("kind", "r.pages_requested", "r.pages_collected", "r.pages_weak", "r.pages_failed")


@query(f"""
WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS mark FROM events),
f AS (SELECT *, updated_us // 1000 AS ms, CASE WHEN stage LIKE 'auditor%' THEN 7200000 ELSE 3600000 END AS patience FROM ({FOLD_SQL})),
d AS (SELECT run_id, ms, CASE WHEN status IN ('completed', 'failed') THEN 'terminal' WHEN stage = 'report_bundle_ready' THEN 'report_ready' WHEN error IS NOT NULL THEN 'failed'
   WHEN ms + patience <= mark THEN 'stale' ELSE 'in_progress' END AS reason FROM f, w)
SELECT run_id, reason = 'in_progress' AS active, reason, ms AS updated_ms FROM d""")
def active_runs_stream(spark, sf):
    """The last word of the stream on every run, after timers have fired."""
    events = status_events(spark, sf, event_stream(spark, sf))
    out = run_stream(spark, X.active_runs_stream(events), "update")
    last = out.groupBy("run_id").agg(F.max_by(F.struct("active", "reason", "updated_at"), "_batch").alias("r"))
    return last.select("run_id", "r.active", "r.reason", F.floor(F.unix_micros("r.updated_at") / 1000).cast("bigint").alias("updated_ms"))
