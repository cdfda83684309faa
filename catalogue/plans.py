"""Whole plans over the driver tables, and per-page blocks that combine several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import CRAWLED_SQL, ORACLE, crawled, query, table
from catalogue.evidence import MAPPING_SQL, QUERIES_SQL, answers, portfolio_queries, site_urls
from catalogue.pages import READY_SQL, SCORED_SQL, TITLE_SQL, _ready_input
from catalogue.texts import TABLE_LINES, count_sql, re2
from citegrain.functions import markdown as M
from citegrain.functions import patterns as P
from citegrain.operators import crawl
from citegrain.plans import refresh, report

WORDS = count_sql("text", P.WORD + "+")


@query(f"""
SELECT doc_id, {WORDS} AS word_count, CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'success'
         WHEN {WORDS} >= 20 THEN 'success' ELSE 'empty_extract' END AS crawl_status FROM documents""")
def page_snapshot(spark, sf):
    d = table(spark, sf, "documents").withColumn("url", F.concat(F.lit("https://h.example/"), F.col("doc_id").cast("string")))
    kind = F.when(F.col("doc_id") % 5 == 0, "application/pdf").otherwise("text/html")
    snap = crawl.page_snapshot(d, kind, F.when(F.col("doc_id") % 13 == 0, "timeout"))
    return snap.select("doc_id", "word_count", "crawl_status")


# RE2 has no look-ahead and an ASCII \b: other letters become x, other marks a blank.
ASCII = r"regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\x{00}-\x{7f}]', ' ', 'g'), '[^\x{00}-\x{7f}]', 'x', 'g')"


@query(f"""
SELECT doc_id, {WORDS} AS word_count, doc_id % 4 AS heading_count, doc_id % 3 AS link_count,
       {count_sql('text', '[?]')} + {count_sql(ASCII, '(what|how|why|when|where|which|can|does|is)' + chr(92) + 'b')} AS question_signal_count,
       {WORDS} >= 250 AS has_substantial_markdown, doc_id % 4 >= 2 AS has_heading_structure FROM documents""")
def extraction_summary(spark, sf):
    n = F.col("doc_id")
    repeat = lambda k: F.array_repeat(F.lit("x"), (n % k).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", M.extraction_summary("text", repeat(4), F.create_map().cast("map<string,string>"), repeat(3)).alias("s"))
    return d.select("doc_id", "s.word_count", "s.heading_count", "s.link_count", "s.question_signal_count", "s.has_substantial_markdown", "s.has_heading_structure")


@query(f"""
SELECT doc_id, len(text) AS raw_markdown_chars, least(len(text), 80000) AS inline_markdown_chars, {count_sql('text', P.CJK)} AS cjk_char_count,
       {count_sql('text', P.LATIN_WORD)} AS latin_word_count, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE {count_sql('text', re2(M.HEADING))} END AS heading_count,
       {count_sql('text', '[?？]')} AS question_count, {count_sql('text', re2(M.BULLET))} AS list_like_block_count, {TABLE_LINES} AS table_like_block_count, 3 AS link_count
FROM documents""")
def content_metrics(spark, sf):
    given = F.struct(
        F.lit(None).cast("int").alias("wordish_count"), F.when(F.col("doc_id") % 2 == 0, 7).alias("heading_count"), F.lit(None).cast("int").alias("question_count"),
        F.lit(None).cast("int").alias("table_line_count"), F.lit(None).cast("int").alias("link_count"), F.lit(None).cast("int").alias("numeric_fact_count"))
    d = table(spark, sf, "documents").withColumn("given", given)
    d = d.select("doc_id", M.content_metrics("text", F.col("given"), F.lit(3), F.lit(0)).alias("m"))
    names = ("raw_markdown_chars", "inline_markdown_chars", "cjk_char_count", "latin_word_count", "heading_count", "question_count",
             "list_like_block_count", "table_like_block_count", "link_count")
    return d.select("doc_id", *[f"m.{n}" for n in names])


# --- refresh ------------------------------------------------------------------------------

@query(f"""
WITH {MAPPING_SQL}
SELECT run_id, (SELECT count(*) FROM ({QUERIES_SQL}) c WHERE c.run_id = m.run_id) AS queries, count(DISTINCT url) AS owned_pages,
       count(*) AS mappings, (SELECT count(*) FROM pages) AS sitemap_urls FROM m GROUP BY run_id""")
def refresh_scope(spark, sf):
    """All queries and all mapped URLs of each run."""
    return refresh.scope(portfolio_queries(spark, sf), site_urls(spark, sf))["counts"]


@query(ORACLE["refresh_scope"])
def refresh_scope_whole(spark, sf):
    return refresh_scope(spark, sf)


def _canonical(spark, sf):
    run = lambda c: (F.col(c) % 3).cast("string").alias("run_id")
    owned = crawled(spark, sf).select(run("pos"), "pos", "url", "title", "markdown", "crawl_status")
    p = table(spark, sf, "pages")
    external = p.select(
        run("page_id"), F.col("page_id").alias("pos"), F.concat(F.lit("https://www.s"), (F.col("page_id") % 9).cast("string"), F.lit(".example.net/a")).alias("url"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("markdown"),
        F.when(F.col("page_id") % 4 == 0, "blocked").otherwise("success").alias("crawl_status"))
    a = answers(spark, sf).withColumn("pos", (F.col("conv_id") * 100 + F.col("turn")).cast("int"))
    return refresh.canonicalise(owned, external, a, a.select("run_id", "pos", "query_id", "query"))


CANONICAL_SQL = rf"""
o AS (SELECT (pos % 3)::VARCHAR AS run_id, crawl_status AS status, {count_sql('markdown', P.WORD_OR_CJK)} AS words, len(markdown) AS chars FROM ({CRAWLED_SQL})),
x AS (SELECT (page_id % 3)::VARCHAR AS run_id, CASE WHEN page_id % 4 = 0 THEN 'blocked' ELSE 'success' END AS status, {count_sql(TITLE_SQL, P.WORD_OR_CJK)} AS words FROM pages),
c AS (SELECT (conv_id % 3)::VARCHAR AS run_id, 3 * count(*) FILTER (conv_id % 5 <> 0) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
os AS (SELECT run_id, count(*) AS owned_page_candidates, count(*) FILTER (status <> 'pending') AS owned_pages_attempted, count(*) FILTER (status = 'success') AS owned_pages_crawled,
   count(*) FILTER (status = 'failed') AS owned_pages_failed, count(*) FILTER (status = 'success' AND words >= 20) AS owned_pages_scoreable FROM o GROUP BY 1),
xs AS (SELECT run_id, count(*) AS external_page_candidates, count(*) AS external_pages_attempted, count(*) FILTER (status = 'success') AS external_pages_crawled,
   count(*) FILTER (status = 'blocked') AS external_pages_failed, count(*) FILTER (status = 'success' AND words >= 20) AS external_pages_scoreable FROM x GROUP BY 1)"""


@query(f"""
WITH {CANONICAL_SQL} SELECT os.*, xs.* EXCLUDE (run_id), c.n AS external_citation_count,
  round_even((owned_pages_crawled + external_pages_crawled)::DOUBLE / (owned_pages_attempted + external_pages_attempted), 4) AS crawl_success_rate
FROM os JOIN xs USING (run_id) JOIN c USING (run_id)""")
def canonical_telemetry(spark, sf):
    return _canonical(spark, sf)["telemetry"]


@query("""
WITH a AS (SELECT (conv_id % 3)::VARCHAR AS run_id, conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0),
c AS (SELECT run_id, 'https://www.s' || (conv_id % 9) || '.example.net/a' AS url FROM a UNION ALL SELECT run_id, 'https://www.s' || ((conv_id + 1) % 9) || '.example.net/a' FROM a
  UNION ALL SELECT run_id, 'https://youtube.com/w' FROM a),
p AS (SELECT (page_id % 3)::VARCHAR AS run_id, 'https://www.s' || (page_id % 9) || '.example.net/a' AS url, arg_min(CASE WHEN page_id % 4 = 0 THEN 'blocked' ELSE 'success' END, page_id) AS status FROM pages GROUP BY 1, 2)
SELECT c.run_id, c.url, count(*) AS citation_count, coalesce(max(p.status), '-') AS crawl_status FROM c LEFT JOIN p USING (run_id, url) GROUP BY 1, 2""")
def canonical_sources(spark, sf):
    s = _canonical(spark, sf)["sources"]
    return s.select("run_id", "url", "citation_count", F.coalesce("crawl_status", F.lit("-")).alias("crawl_status"))


# --- report -------------------------------------------------------------------------------

@query(rf"""
WITH s AS ({READY_SQL}), {SCORED_SQL},
r AS (SELECT run_id, lower(url) AS url_key, pos, score, pos % 2 = 0 AS reported, pos % 7 = 0 OR pos % 11 = 0 AS mapped FROM z),
n AS (SELECT run_id, count(*) AS citations FROM z GROUP BY 1),
k AS (SELECT *, CASE WHEN reported AND pos % 10 <> 0 THEN (pos % 10)::DOUBLE ELSE score END AS current_geo_score_120 FROM r WHERE reported OR crawl_ok(pos))
SELECT run_id, url_key, current_geo_score_120, mapped AS query_mapped, citations FROM k JOIN n USING (run_id)""".replace("crawl_ok(pos)", "pos % 4 <> 0"))
def report_readiness(spark, sf):
    """Reported rows carry a score unless zero; crawled artifacts add pages and computed scores; citations are distinct."""
    p = _ready_input(spark, sf)
    n = F.col("pos")
    reported = p.where("pos % 2 = 0").withColumn("current_geo_score_120", (n % 10).cast("double"))
    workbench = p.where("pos % 7 = 0").select("run_id", "pos", F.col("pos").cast("string").alias("query_id"), F.col("title").alias("query"), F.concat("url", F.lit("/#x")).alias("url"))
    recommendations = p.where("pos % 11 = 0").select("run_id", F.concat(F.upper("url"), F.lit("/")).alias("url"))
    cited = p.select("run_id", (n % 5).cast("string").alias("query_id"), "url", (n % 3).alias("citation_position"), F.lit(0).alias("source_rank"), "pos")
    again = cited.where("pos % 2 = 0").withColumns({"url": F.concat("url", F.lit("#x")), "source_rank": F.lit(1)})
    out = report.enrich(reported, [p], workbench, recommendations, cited.unionByName(again))
    citations = out["citations"].groupBy("run_id").agg(F.count("*").alias("citations"))
    return out["readiness"].join(citations, "run_id").select("run_id", "url_key", "current_geo_score_120", "query_mapped", "citations")
