"""Citation, answer, mapping, merging and inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import (
    CITATION_ORDER, CITATION_ORDER_SQL, CITATIONS_SQL, CRAWLED_SQL, OWNED, citations, crawled, query, table,
)
from catalogue.pages import TITLE_SQL
from catalogue.texts import compact_sql
from catalogue.urls import AUTH, LANG
from citegrain.functions import patterns as P
from citegrain.functions import url as U
from citegrain.operators import citations as C
from citegrain.operators import classify, dedupe, mapping, merging
from citegrain.operators.frames import first_n
from citegrain.session import checkpointed

RUN_QUERY = ("run_id", "query_id")


# --- citations ----------------------------------------------------------------------------

@query(f"""
WITH c AS ({CITATIONS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY query_id, {CITATION_ORDER_SQL}) AS rn,
   count(*) OVER (PARTITION BY run_id, url) AS citation_count FROM c)
SELECT run_id, url, citation_count, source_type, source_domain FROM r WHERE rn = 1""")
def citation_sources(spark, sf):
    return C.sources(citations(spark, sf), ("run_id",), ("query_id", *CITATION_ORDER), ("source_type", "source_domain"))


@query(f"SELECT run_id, url, query_id, count(*) AS citations FROM ({CITATIONS_SQL}) GROUP BY ALL")
def citation_source_queries(spark, sf):
    return C.source_queries(citations(spark, sf))


@query(f"""
WITH s AS (SELECT run_id, url, min(source_type) AS st FROM ({CITATIONS_SQL}) GROUP BY 1, 2)
SELECT run_id, coalesce(nullif(st, ''), 'external_citation') AS source_type, count(*) AS sources FROM s GROUP BY 1, 2""")
def source_type_counts(spark, sf):
    s = C.sources(citations(spark, sf), ("run_id",), ("query_id", *CITATION_ORDER))
    return C.source_type_counts(s, "run_id")


PER_QUERY_SQL = f"""
SELECT query_id, count(*) AS citation_count, arg_min(source_domain, (citation_position, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS leading_citation_domain,
       array_to_string(list_sort(list_distinct(list(coalesce(nullif(source_type, ''), 'external_citation')))), ',') AS winning_source_types
FROM ({CITATIONS_SQL}) GROUP BY 1"""


@query(f"""
SELECT o_orderkey AS query_id, coalesce(citation_count, 0) AS citation_count, coalesce(leading_citation_domain, '-') AS leading_citation_domain,
       coalesce(winning_source_types, '') AS winning_source_types,
       CASE WHEN citation_count > 0 THEN 'serpapi_collected_with_citations' ELSE 'serpapi_collected_no_citations' END AS visibility_status
FROM orders LEFT JOIN ({PER_QUERY_SQL}) ON query_id = o_orderkey""")
def citation_per_query(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    v = C.visibility(asked, citations(spark, sf), ("query_id",), CITATION_ORDER)
    return v.select("query_id", "citation_count", F.coalesce("leading_citation_domain", F.lit("-")).alias("leading_citation_domain"),
                    F.array_join("winning_source_types", ",").alias("winning_source_types"), "visibility_status")


@query(f"""
WITH r AS (SELECT query_id, url, citation_position, row_number() OVER (PARTITION BY query_id ORDER BY {CITATION_ORDER_SQL}) AS rank FROM ({CITATIONS_SQL}))
SELECT * FROM r WHERE rank <= 3""")
def top_citations(spark, sf):
    return C.top_citations(citations(spark, sf), ("query_id",), CITATION_ORDER).select("query_id", "url", "citation_position", "rank")


@query(f"""
WITH c AS (SELECT query_id, lower(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS k, citation_position, source_type, l_shipdate, l_extendedprice FROM ({CITATIONS_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, k, citation_position ORDER BY l_shipdate, l_extendedprice) AS rn FROM c)
SELECT query_id, k AS url_key, citation_position, epoch_us(l_shipdate) AS shipped, l_extendedprice FROM r WHERE rn = 1""")
def citation_dedupe(spark, sf):
    c = citations(spark, sf)
    mixed = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.upper("url"), F.lit("/#x"))).otherwise(F.col("url"))
    d = C.distinct_citations(c.withColumn("url", mixed), order=("l_shipdate", "l_extendedprice"))
    return d.select("query_id", U.url_key("url").alias("url_key"), "citation_position",
                    F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"), "l_extendedprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate) AS shipped,
       CASE WHEN l_linenumber % 3 = 0 THEN 100 + l_partkey WHEN l_linenumber % 3 = 1 THEN l_linenumber ELSE l_suppkey + 1 END AS citation_position FROM lineitem""")
def citation_rank(spark, sf):
    n = F.col("l_linenumber") % 3
    li = table(spark, sf, "lineitem").withColumns({
        "rank": F.when(n == 0, 100 + F.col("l_partkey")), "given": F.when(n == 1, F.col("l_linenumber")), "pos": F.col("l_suppkey")})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"),
                     C.citation_rank("rank", "given").alias("citation_position"))


HINT_ORDER = "(query_id, citation_position, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


@query(f"""
WITH c AS (SELECT *, CASE WHEN l_partkey % 4 <> 0 THEN 'T' || citation_position END AS title FROM ({CITATIONS_SQL})),
h AS (SELECT run_id, url, arg_max(title, {HINT_ORDER}) FILTER (title IS NOT NULL) AS title, arg_max(source_type, {HINT_ORDER}) AS source_type FROM c GROUP BY 1, 2)
SELECT s.s_suppkey, p.p_partkey, coalesce(h.title, '-') AS title, coalesce(h.source_type, '-') AS source_type
FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % 100
LEFT JOIN h ON h.run_id = ['A', 'N', 'R'][p.p_partkey % 3 + 1] AND h.url = 'https://s' || s.s_suppkey || '.example.net/p/' || p.p_partkey""")
def hint_fill(spark, sf):
    cites = citations(spark, sf).withColumns({
        "title": F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("T"), F.col("citation_position").cast("string"))),
        "ord": F.struct("query_id", *CITATION_ORDER),
    })
    suppliers = table(spark, sf, "supplier")
    pages = table(spark, sf, "part").join(suppliers, F.col("s_suppkey") == F.col("p_partkey") % 100).select(
        "s_suppkey", "p_partkey", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("run_id"),
        F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.net/p/"), F.col("p_partkey").cast("string")).alias("url"),
    )
    out = merging.fill_from_hints(pages, cites, ("title", "source_type"))
    return out.select("s_suppkey", "p_partkey", F.coalesce("hint_title", F.lit("-")).alias("title"),
                      F.coalesce("hint_source_type", F.lit("-")).alias("source_type"))


@query("SELECT c_mktsegment AS run_id, c_nationkey::VARCHAR AS category, n FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS f, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, min(c_custkey)) AS rn FROM customer WHERE c_nationkey <> 0 GROUP BY 1, 2) WHERE rn = 1")
def top_category(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("run_id"), F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("category"),
        F.col("c_custkey").alias("pos"))
    return C.most_common(c, "category", ("run_id",))


@query("SELECT o_orderpriority AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'not_validated' ELSE o_orderstatus END AS query_type, count(*) AS queries FROM orders GROUP BY 1, 2")
def type_mix(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("query_type"))
    return C.query_type_mix(o, "run_id")


# --- answers ------------------------------------------------------------------------------

def answers(spark, sf):
    """Assistant turns as AI answers; references built from the turn's own numbers."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    site = lambda n: F.concat(F.lit("https://www.s"), ((F.col("conv_id") + n) % 9).cast("string"), F.lit(".example.net/a"))
    ref = lambda **kw: F.struct(*[
        kw.get(f, F.lit(None).cast(t)).cast(t).alias(f) for f, t in (
            ("rank", "bigint"), ("title", "string"), ("url", "string"), ("source_url", "string"), ("link", "string"),
            ("source_domain", "string"), ("source_name", "string"), ("source", "string"), ("snippet", "string"),
            ("description", "string"), ("text", "string"), ("source_type", "string"))
    ])
    refs = F.when(F.col("conv_id") % 5 != 0, F.array(
        ref(url=site(0), title=F.lit("First  title"), rank=F.lit(7)),
        ref(source_url=site(1), source=F.lit("Source")),
        ref(link=site(0), title=F.lit("again")),
        ref(url=F.lit("ftp://nowhere")),
        ref(url=F.lit("https://youtube.com/w"), source_domain=F.lit("yt"), description=F.lit(" d \n e ")),
    ))
    return c.select(
        (F.col("conv_id") % 3).cast("string").alias("run_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("query"), "conv_id", "turn", refs.alias("references"),
        F.when(F.col("turn") % 4 == 1, "SerpAPI collection pending.").otherwise(F.col("text")).alias("answer_summary"),
        F.when(F.col("turn") % 4 == 1, "pending_collection").when(F.col("turn") % 4 == 3, "done").alias("status"),
    )


@query(f"""
WITH a AS (SELECT *, conv_id || '-' || turn AS query_id, (conv_id % 5 <> 0) AS cited FROM conversations WHERE role = 'assistant')
SELECT query_id, CASE WHEN cited THEN 3 ELSE 0 END AS citation_count,
  CASE WHEN cited THEN 'https://www.s' || (conv_id % 9) || '.example.net/a,https://www.s' || ((conv_id + 1) % 9) || '.example.net/a,https://youtube.com/w' ELSE '' END AS urls,
  CASE WHEN cited THEN '7,2,5' ELSE '' END AS ranks, CASE WHEN cited THEN 'First title|s' || ((conv_id + 1) % 9) || '.example.net|youtube.com' ELSE '' END AS titles,
  CASE WHEN cited THEN 's' || (conv_id % 9) || '.example.net|Source|youtube.com' ELSE '' END AS names, CASE WHEN cited THEN '||d e' ELSE '' END AS snippets,
  CASE WHEN cited THEN 'external_citation,external_citation,forum_social_video' ELSE '' END AS types,
  md5(CASE WHEN turn % 4 = 1 OR {compact_sql('text')} = '' THEN CASE WHEN cited THEN 'SerpAPI completed; citation references were returned.' ELSE 'SerpAPI completed but no AI answer summary was returned.' END
       ELSE {compact_sql('text')} END) AS summary,
  CASE WHEN turn % 4 = 3 THEN 'done' WHEN cited THEN 'serpapi_completed_with_citations' ELSE 'serpapi_completed_no_citations' END AS status
FROM a""")
def answer_normalise(spark, sf):
    n = C.normalise_answers(answers(spark, sf))
    join = lambda field, sep: F.array_join(F.transform("references", lambda r: F.coalesce(r[field].cast("string"), F.lit(""))), sep)
    return n.select("query_id", "citation_count", join("url", ",").alias("urls"), join("rank", ",").alias("ranks"), join("title", "|").alias("titles"),
                    join("source_name", "|").alias("names"), join("snippet", "|").alias("snippets"), join("source_type", ",").alias("types"),
                    F.md5("answer_summary").alias("summary"), "status")


@query("""
SELECT (conv_id % 3)::VARCHAR AS run_id, count(*) AS captured_queries, count(*) FILTER (conv_id % 5 <> 0) AS queries_with_citations,
       3 * count(*) FILTER (conv_id % 5 <> 0) AS total_citations FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def answer_totals(spark, sf):
    return C.answer_totals(C.normalise_answers(answers(spark, sf)), "run_id")


@query("""
WITH a AS (SELECT (conv_id % 3)::VARCHAR AS run_id, conv_id || '-' || turn AS query_id, text AS query, conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT run_id, query_id FROM a WHERE run_id = '2' OR conv_id % 7 = 0 OR lower(regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' $', '')) IN
   (SELECT lower(regexp_replace(trim(regexp_replace(b.query, '\\s+', ' ', 'g')), ' $', '')) FROM a b WHERE b.run_id = a.run_id AND b.turn % 4 = 3)""")
def answer_reuse(spark, sf):
    a = answers(spark, sf)
    asked = a.where("run_id <> '2'").select("run_id", "query_id", "query", "conv_id", "turn")
    by_id = asked.where("conv_id % 7 = 0").select("run_id", "query_id", F.lit(None).cast("string").alias("query"))
    by_text = asked.where("turn % 4 = 3").select("run_id", F.lit("").alias("query_id"), F.concat(F.lit(" \n"), "query").alias("query"))
    return C.reusable_answers(a, by_id.unionByName(by_text)).select("run_id", "query_id")


# --- query → page mapping -----------------------------------------------------------------

def portfolio_queries(spark, sf):
    """User turns as queries of one portfolio per topic run, with a few intent words."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    n = F.col("conv_id")
    word = F.when(n % 5 == 0, "ev service").when(n % 5 == 1, "dealer finance").when(n % 5 == 2, "safety").otherwise("")
    pos = (n * 100 + F.col("turn")).alias("pos")
    return c.select(
        F.when(n % 2 == 0, "even").otherwise("odd").alias("run_id"), pos, F.format_string("q%05d", pos).alias("query_id"),
        "text", F.col("text").alias("query"), word.alias("topic"), F.lit("example page").alias("recommended_page_type"),
    ).drop("text")


def site_urls(spark, sf):
    """Page URLs with their title as path, as sitemaps have them; both runs see all of them."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("pos"),
        F.concat(U.base_url("url"), F.when(F.col("page_id") % 7 == 0, "/service/dealer/").otherwise("/"),
                 F.regexp_replace(title, r"[^\p{L}0-9]+", "-"), F.lit("/"), F.col("page_id").cast("string")).alias("url"),
    )
    return p.select(F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("run_id"), "pos", "url")


QUERIES_SQL = """
SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id, conv_id * 100 + turn AS pos, printf('q%05d', conv_id * 100 + turn) AS query_id, text AS query,
       CASE conv_id % 5 WHEN 0 THEN 'ev service' WHEN 1 THEN 'dealer finance' WHEN 2 THEN 'safety' ELSE '' END AS topic, 'example page' AS recommended_page_type
FROM conversations WHERE role = 'user'"""
URLS_SQL = rf"""
SELECT run_id, page_id AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN page_id % 7 = 0 THEN '/service/dealer/' ELSE '/' END
       || regexp_replace({TITLE_SQL}, '[^\p{{L}}0-9]+', '-', 'g') || '/' || page_id AS url FROM pages, (VALUES ('even'), ('odd')) r(run_id)"""
_tok = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[{P.TOKEN_CHARS}]+'), lambda t: len(t) >= 3))"
_boost_sql = " + ".join(
    f"CASE WHEN contains(qt, '{q}') AND ({' OR '.join(f'contains(lower(url), {chr(39)}{u}{chr(39)})' for u in us)}) THEN 3 ELSE 0 END"
    for q, us in mapping.BOOST_RULES
)
MAPPING_SQL = f"""
q AS (SELECT *, lower(query || ' ' || topic || ' ' || recommended_page_type) AS qt FROM ({QUERIES_SQL})),
qq AS (SELECT *, {_tok('qt')} AS qtok FROM q),
u AS (SELECT run_id, pos AS upos, url, {_tok("translate(url, '-_/', '   ')")} AS utok FROM ({URLS_SQL})),
p AS (SELECT qq.run_id, query_id, pos AS qpos, topic, query, url, upos, len(list_intersect(qtok, utok)) + {_boost_sql} AS score FROM qq JOIN u USING (run_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, len(url), upos) AS rank,
        max(score) OVER (PARTITION BY run_id, query_id) AS best FROM p),
m AS (SELECT run_id, query_id, qpos, topic, query, url, upos, rank, score AS mapping_score FROM r WHERE rank <= 3 AND (score > 0 OR best = 0))"""


@query(f"WITH {MAPPING_SQL} SELECT run_id, query_id, url, rank, mapping_score, CASE WHEN mapping_score >= 44 THEN 'strong' WHEN mapping_score >= 26 THEN 'acceptable' ELSE 'weak' END AS quality FROM m")
def query_page_mapping(spark, sf):
    m = mapping.map_queries(portfolio_queries(spark, sf), site_urls(spark, sf), 3)
    return m.select("run_id", "query_id", "url", "rank", "mapping_score", classify.mapping_quality("mapping_score").alias("quality"))


@query(f"""
WITH {MAPPING_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY qpos, rank) AS n FROM m)
SELECT run_id, url, count(*) AS query_count, max(mapping_score) AS mapping_score, coalesce(arg_min(topic, qpos * 10 + rank) FILTER (topic <> ''), '-') AS brand_topic_category,
       md5(string_agg(query, '|' ORDER BY n)) AS related FROM o GROUP BY 1, 2""")
def mapping_rollup(spark, sf):
    q = portfolio_queries(spark, sf)
    r = mapping.mapping_rollup(checkpointed(mapping.map_queries(q, site_urls(spark, sf), 3)), q)
    return r.select("run_id", "url", "query_count", "mapping_score", F.coalesce("brand_topic_category", F.lit("-")).alias("brand_topic_category"),
                    F.md5(F.array_join("related_queries_seed", "|")).alias("related"))


@query(f"""
WITH {MAPPING_SQL}, f AS (SELECT run_id, url, min(qpos * 10 + rank) AS f FROM m GROUP BY 1, 2), n AS (SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY f) AS rank FROM f)
SELECT * FROM n""")
def mapped_url_selection(spark, sf):
    m = mapping.map_queries(portfolio_queries(spark, sf), site_urls(spark, sf), 3)
    return mapping.selected_urls(m).select("run_id", "url", "rank")


# --- merging ------------------------------------------------------------------------------

def _existing_and_crawled(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("run_id"), F.col("page_id").alias("pos"), "url")
    n = F.col("pos")
    existing = p.where("pos % 3 <> 0").withColumns({"title": F.concat(F.lit("old"), n.cast("string")), "crawl_status": F.lit("pending")})
    crawled_pages = p.where("pos % 2 = 0").select(
        "run_id", "pos", F.concat("url", F.lit("?fetched")).alias("url"), F.col("url").alias("source_url"), F.col("url").alias("final_url"),
        F.when(n % 4 == 0, F.concat(F.lit("new"), n.cast("string"))).alias("title"), F.lit("success").alias("crawl_status"),
    )
    return existing, crawled_pages


@query(rf"""
WITH p AS (SELECT {LANG} AS run_id, page_id AS pos, url FROM pages)
SELECT run_id, 0 AS side, pos, CASE WHEN pos % 2 = 0 THEN url || '?fetched' ELSE url END AS url,
       CASE WHEN pos % 4 = 0 THEN 'new' || pos ELSE 'old' || pos END AS title, CASE WHEN pos % 2 = 0 THEN 'success' ELSE 'pending' END AS crawl_status FROM p WHERE pos % 3 <> 0
UNION ALL SELECT run_id, 1, pos, url || '?fetched', CASE WHEN pos % 4 = 0 THEN 'new' || pos ELSE '-' END, 'success' FROM p WHERE pos % 3 = 0 AND pos % 2 = 0""")
def merge_pages(spark, sf):
    m = merging.merge_pages(*_existing_and_crawled(spark, sf))
    return m.select("run_id", "merge_pos.side", "merge_pos.pos", "url", F.coalesce("title", F.lit("-")).alias("title"), "crawl_status")


@query(rf"""
WITH p AS (SELECT {LANG} AS run_id, page_id AS pos, url FROM pages WHERE page_id % 2 = 0)
SELECT run_id, a AS alias, min(pos) AS page_pos FROM (SELECT run_id, pos, url || '?fetched' AS a FROM p UNION ALL SELECT run_id, pos, url FROM p) GROUP BY 1, 2""")
def page_alias_index(spark, sf):
    return merging.alias_index(_existing_and_crawled(spark, sf)[1]).select("run_id", "alias", "page_pos")


@query(f"""
WITH d AS ({CRAWLED_SQL}),
a AS (SELECT run_id, pos, lower(url) AS url_key, 0 AS l, CASE WHEN pos % 3 = 0 THEN '' ELSE 'report' || pos END AS title, CASE WHEN pos % 4 <> 0 THEN pos % 50 ELSE 0 END AS score, pos % 5 = 0 AS mapped FROM d WHERE pos % 2 = 0
  UNION ALL SELECT run_id, pos, lower(url), 1, 'crawl' || pos, 60, pos % 7 = 0 FROM d WHERE pos % 3 = 0)
SELECT run_id, url_key, coalesce(arg_min(title, l) FILTER (title <> ''), '-') AS title, coalesce(arg_min(score, l) FILTER (score <> 0), -1)::DOUBLE AS current_geo_score_120,
       bool_or(mapped) AS query_mapped FROM a GROUP BY 1, 2""")
def report_merge(spark, sf):
    d = crawled(spark, sf)
    n = F.col("pos")
    base = lambda df: df.select("run_id", "pos", F.lower("url").alias("url_key"), "title", F.col("score").cast("double").alias("current_geo_score_120"), "query_mapped")
    report = base(d.where("pos % 2 = 0").withColumns({
        "title": F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("report"), n.cast("string"))),
        "score": F.when(n % 4 != 0, n % 50).otherwise(0), "query_mapped": n % 5 == 0}))
    artifact = base(d.where("pos % 3 = 0").withColumns({"title": F.concat(F.lit("crawl"), n.cast("string")), "score": F.lit(60), "query_mapped": n % 7 == 0}))
    m = merging.merge_report_rows(report, artifact)
    return m.select("run_id", "url_key", F.coalesce("title", F.lit("-")).alias("title"),
                    F.coalesce("current_geo_score_120", F.lit(-1.0)).alias("current_geo_score_120"), "query_mapped")


@query(f"""
WITH w AS (SELECT run_id, lower(url) AS k, 1 AS r FROM ({CITATIONS_SQL}) WHERE citation_position <= 2
  UNION ALL SELECT run_id, lower(url), 0 FROM ({CITATIONS_SQL}) WHERE citation_position = 3)
SELECT run_id, k AS url_key, sum(r)::BIGINT AS related_queries FROM w GROUP BY 1, 2""")
def mapped_pages(spark, sf):
    c = citations(spark, sf)
    workbench = c.where("citation_position <= 2").select("run_id", "query_id", F.lit("q").alias("query"), F.concat("url", F.lit("/#top")).alias("url"))
    return merging.mapped_pages(workbench, c.where("citation_position = 3").select("run_id", "url"))


# --- inventories --------------------------------------------------------------------------

@query(f"""
WITH c AS (SELECT run_id, url, l_orderkey * 10 + l_linenumber AS pos, l_suppkey FROM (SELECT *, l_returnflag AS run_id, 'https://s' || l_suppkey || '.example.net/p/' || l_partkey AS url FROM lineitem)),
u AS (SELECT run_id, url, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT run_id, url, pos FROM u""")
def distinct_urls(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_returnflag").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.lit(" https://s"), F.col("l_suppkey").cast("string"), F.lit(".example.net/p/"), F.col("l_partkey").cast("string"),
                 F.lit("#"), F.col("l_linenumber").cast("string")).alias("url"))
    return dedupe.distinct_urls(rows)


@query("""
WITH q AS (SELECT c_mktsegment AS run_id, c_custkey AS pos, 'nation ' || c_nationkey || ' offers' AS k FROM customer)
SELECT run_id, min(pos) AS pos, k FROM q GROUP BY 1, 3""")
def query_dedupe(spark, sf):
    n = F.col("c_custkey")
    text = F.concat(F.when(n % 2 == 0, "  Nation  ").otherwise("nation "), F.col("c_nationkey").cast("string"), F.lit("\tOffers "))
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("run_id"), n.alias("pos"), text.alias("query"))
    d = dedupe.distinct_queries(rows)
    return d.select("run_id", "pos", F.lower(F.regexp_replace(F.trim(F.regexp_replace("query", r"\s+", " ")), " $", "")).alias("k"))


@query("SELECT min(p_partkey) AS pos, p_brand AS brand, p_size AS size FROM part GROUP BY 2, 3")
def distinct_nested(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("v"))
    return dedupe.distinct_by(p, "v").select("pos", "v.brand", "v.size")


@query(f"""
WITH c AS (SELECT l_returnflag AS run_id, 0 AS part, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'https://www.example.com/' ELSE 'https://s' || l_suppkey || '.example.net/' END || l_partkey AS url FROM lineitem
  UNION ALL SELECT 'A', 1, page_id, split_part(url, '#', 1) FROM pages),
u AS (SELECT run_id, url, min(part * 1000000000000 + pos) AS f FROM c GROUP BY 1, 2),
s AS (SELECT *, regexp_matches({AUTH}, '(^|\\.)example\\.(com|org)$') AS is_owned FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, is_owned ORDER BY f, url) AS rank FROM s)
SELECT run_id, url, is_owned, rank FROM r WHERE rank <= CASE WHEN is_owned THEN 2000 ELSE 30 END""")
def inventory_union(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_suppkey")
    first = li.select(
        F.col("l_returnflag").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(F.when(n % 3 == 0, "https://www.example.com/").otherwise(F.concat(F.lit("https://s"), n.cast("string"), F.lit(".example.net/"))),
                 F.col("l_partkey").cast("string")).alias("url"))
    second = table(spark, sf, "pages").select(F.lit("A").alias("run_id"), F.col("page_id").alias("pos"), "url")
    runs = li.select(F.col("l_returnflag").alias("run_id")).distinct()
    domains = runs.select("run_id", F.explode(F.array(*[F.lit(d) for d in OWNED])).alias("domain"))
    inv = dedupe.inventory([first, second], dedupe.owned_domains(domains), 2000, 30)
    return inv.select("run_id", "url", "is_owned", "rank")


@query("""
WITH r AS (SELECT c_mktsegment AS run_id, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rank FROM customer)
SELECT * FROM r WHERE rank <= 100""")
def first_n_per_run(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("run_id"), "c_custkey")
    return first_n(c, "run_id", ["c_custkey"], 100)


@query("""
SELECT o_orderpriority AS run_id, o_orderkey AS pos, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 7 AS batch FROM orders""")
def batches(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("pos"))
    return dedupe.with_batches(o, 7)


SCOPE_SQL = "SELECT l_returnflag AS run_id, 'https://p.example/' || l_partkey AS url, l_orderkey AS q, l_linenumber AS ln, l_suppkey AS s, l_shipdate, l_extendedprice, l_orderkey * 10 + l_linenumber AS o FROM lineitem"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY o, s, l_shipdate, l_extendedprice) AS n FROM ({SCOPE_SQL}))
SELECT run_id, url, max(CASE WHEN n = 1 THEN s END)::BIGINT AS supplier, count(*) AS related, sum(q)::BIGINT AS query_sum FROM r GROUP BY 1, 2""")
def scope_pages(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_returnflag").alias("run_id"), F.concat(F.lit("https://p.example/"), F.col("l_partkey").cast("string")).alias("url"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), "l_suppkey", "l_shipdate", "l_extendedprice").alias("pos"),
        F.lit("c").alias("brand_topic_category"), F.col("l_orderkey").alias("query_id"), F.lit("q").alias("query"), F.lit("t").alias("query_type"),
        F.lit("high").alias("priority"), F.col("l_suppkey").alias("supplier"))
    pages, related = dedupe.selected_pages(rows)
    sums = related.groupBy("run_id", "url").agg(F.count("*").alias("related"), F.sum("query_id").alias("query_sum"))
    return pages.join(sums, ["run_id", "url"]).select("run_id", "url", "supplier", "related", "query_sum")
