"""HTML, crawl, readiness, scoring and hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import CRAWLED_SQL, ORACLE, OWNED, crawled, in_list, query, quoted, table
from catalogue.texts import (
    NUMBER_RE2, block_sql, clean_sql, compact_sql, count_sql, line_key_sql, numeric_count_sql, questions_sql, re2,
)
from catalogue.urls import AUTH, HOST
from citegrain.functions import markdown as M
from citegrain.functions import patterns as P
from citegrain.functions import text as T
from citegrain.functions import url as U
from citegrain.operators import crawl, hygiene as H, readiness as R, signals as S, text_scores as X
from citegrain.operators import page_features as PF

TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
BASE_SQL = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"


def decoded(c: str) -> str:
    for pattern, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;?|&#39;?", "''"), ("&amp;?", "&")):
        c = f"regexp_replace({c}, '{pattern}', '{char}', 'g')"
    return c


def features(spark, sf):
    return PF.page_features(table(spark, sf, "pages"))


# --- HTML ---------------------------------------------------------------------------------

@query(rf"""
SELECT page_id, {decoded(compact_sql(TITLE_SQL))} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
       {decoded(compact_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1, len(regexp_extract_all(html, '<h1>')) AS headings,
       len(regexp_extract_all(html, '<a href="')) AS anchors, 0 AS linked_data
FROM pages""")
def html_features(spark, sf):
    return features(spark, sf).select(
        "page_id", T.compact("title").alias("title"), "language", F.get("headings", F.lit(0))["text"].alias("h1"),
        F.size("headings").alias("headings"), F.size("anchors").alias("anchors"), F.col("json_ld_block_count").alias("linked_data"),
    )


LINKS_SQL = rf"""
SELECT page_id, url, h AS href, CASE WHEN h LIKE 'http%' THEN h ELSE {BASE_SQL} || h END AS link, t AS label
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h,
             unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t FROM pages)"""


@query(rf"""
WITH l AS ({LINKS_SQL})
SELECT page_id, link AS url, label AS text, link LIKE '%.pdf%' AS is_pdf, 1 AS n FROM l GROUP BY 1, 2, 3""")
def html_links(spark, sf):
    return features(spark, sf).select("page_id", F.explode_outer("links").alias("l")).where("l IS NOT NULL").select(
        "page_id", "l.url", "l.text", "l.is_pdf", F.lit(1).alias("n")
    )


@query(rf"""
WITH l AS ({LINKS_SQL}), d AS (SELECT DISTINCT page_id, url, link, label FROM l),
h AS (SELECT page_id, regexp_replace(lower(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS target_host FROM d)
SELECT target_host, count(*) AS links, count(DISTINCT page_id) AS linking_pages, 0 AS pdf_links FROM h GROUP BY 1""")
def link_host_counts(spark, sf):
    return PF.link_host_counts(features(spark, sf))


# Pages have no tables, images, meta tags or linked data, so parts built from the page's own
# columns are put into its markup; what must come out follows from the same columns.
def rich_pages(spark, sf):
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    word = F.regexp_extract("url", r"/([a-z]+)/\d+", 1)
    ld = (
        F.when(n % 4 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","offers":[{"@type":"Offer"}],"id":'), n.cast("string"), F.lit("}</script>")))
        .when(n % 4 == 1, F.lit('<script type="application/LD+JSON">[{"@type":["FAQPage","WebPage"]},{"x":{"@type":"Question"}}]</script>'))
        .when(n % 4 == 2, F.lit('<script type="application/ld+json">{"@type": "Broken", </script>'))
        .otherwise("")
    )
    head = F.concat(
        F.lit('<meta name="description" content="About '), word, F.lit(' pages"><meta name="robots" content="'),
        F.when(n % 2 == 0, "noindex").otherwise("index"), F.lit('"><link rel="canonical" href="'), F.col("url"),
        F.lit('"><link rel="alternate" hreflang="ja" href="/ja">'), ld, F.lit("</head>"),
    )
    extra = F.concat(
        F.lit('<h2>Facts &amp; figures</h2><table><tr><th>Item</th><th>Value</th></tr><tr><td>id</td><td>'), n.cast("string"),
        F.lit("</td></tr><tr><td>only</td></tr></table><img src='/i/"), n.cast("string"),
        F.lit(".png' alt='Picture'><img data-src='lazy.png'><img alt=''><div class='cookie-banner'>We use cookies</div>"
              "<span aria-hidden='true'>hidden</span><iframe title='Demo video'></iframe><a href='/spec.PDF'>Spec</a>"
              "<a href='mailto:a@b.c'>Mail</a></article>"),
    )
    html = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("</article>"), extra)
    return p.withColumn("html", html)


def rich_features(spark, sf):
    return PF.page_features(rich_pages(spark, sf))


@query(rf"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Product,Offer' WHEN 1 THEN 'FAQPage,WebPage,Question' WHEN 2 THEN 'Broken' ELSE '' END AS schema_types,
       CASE page_id % 4 WHEN 0 THEN 'Offer,Product' WHEN 1 THEN 'Question' WHEN 2 THEN 'Broken' ELSE '' END AS schema_types_detected,
       (page_id % 4 < 3)::INT AS blocks, (page_id % 4 < 2)::INT AS valid_blocks,
       'About ' || regexp_extract(url, '/([a-z]+)/\d+', 1) || ' pages' AS description,
       CASE WHEN page_id % 2 = 0 THEN 'noindex' ELSE 'index' END AS robots, url AS canonical,
       'ja=' || {BASE_SQL} || '/ja' AS hreflang, 6 AS meta_count
FROM pages""")
def schema_types(spark, sf):
    return rich_features(spark, sf).select(
        "page_id", F.array_join("schema_types", ",").alias("schema_types"),
        F.array_join("schema_types_detected", ",").alias("schema_types_detected"),
        F.col("json_ld_block_count").alias("blocks"), F.col("json_ld_valid_count").alias("valid_blocks"), "description",
        F.col("robots_meta").alias("robots"), F.col("canonical_url").alias("canonical"),
        F.array_join(F.transform("hreflang", lambda h: F.concat(h["hreflang"], F.lit("="), h["href"])), ",").alias("hreflang"),
        (F.size("meta") + 4).alias("meta_count"),
    )


@query(rf"""
SELECT page_id, 0 AS pos, {BASE_SQL} || '/i/' || page_id || '.png' AS src, 'Picture' AS alt FROM pages
UNION ALL SELECT page_id, 1, regexp_extract(url, '^([^?#]*/)', 1) || 'lazy.png', '' FROM pages""")
def page_images(spark, sf):
    return rich_features(spark, sf).select("page_id", F.posexplode_outer("images").alias("pos", "i")).where("pos IS NOT NULL").select("page_id", "pos", "i.src", "i.alt")


@query(r"""
SELECT page_id, '### Table 1' || chr(10) || chr(10) || '| Item | Value |' || chr(10) || '| --- | --- |' || chr(10)
       || '| id | ' || page_id || ' |' || chr(10) || '| only |  |' AS tables FROM pages""")
def page_tables(spark, sf):
    return rich_features(spark, sf).select("page_id", PF.tables_markdown(F.col("tables")).alias("tables"))


@query("""
WITH d AS (SELECT doc_id, text AS body, CASE doc_id % 4 WHEN 0 THEN '  ' || left(text, len(text) // 2) || ' ' WHEN 1 THEN left(text, len(text) // 5) WHEN 2 THEN '' END AS extracted,
  CASE WHEN doc_id % 3 = 0 THEN '# ' || text WHEN doc_id % 3 = 1 THEN left(text, len(text) // 3) END AS md FROM documents),
b AS (SELECT *, CASE WHEN coalesce(len(extracted), 0) > len(body) * 0.3::DOUBLE THEN regexp_replace(extracted, '^\\s+|\\s+$', '', 'g') ELSE body END AS best FROM d)
SELECT doc_id, md5(best) AS text_md5, md5(CASE WHEN coalesce(len(md), 0) >= len(best) THEN coalesce(md, '') ELSE best END) AS markdown_md5 FROM b""")
def chosen_text(spark, sf):
    """Best text and Markdown of every document as a page: what an extractor took, the body, or the Markdown."""
    n, size = F.col("doc_id") % 4, F.length("text")
    part = lambda k: F.left("text", F.floor(size / k).cast("int"))
    d = table(spark, sf, "documents").withColumns({
        "extracted": F.when(n == 0, F.concat(F.lit("  "), part(2), F.lit(" "))).when(n == 1, part(5)).when(n == 2, ""),
        "md": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("doc_id") % 3 == 1, part(3))})
    found = d.select("doc_id", PF.chosen_text(F.col("md"), F.col("text"), F.col("extracted")).alias("c"))
    return found.select("doc_id", F.md5("c.text").alias("text_md5"), F.md5("c.markdown").alias("markdown_md5"))


@query(r"""
SELECT page_id, false AS cookie_in_main, false AS hidden_in_main, true AS media_in_main, true AS heading_in_main, true AS cookie_in_text,
       len(regexp_extract(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '(?s)<footer>(.*?)</footer>', 1)) AS footer_chars
FROM pages""")
def html_noise(spark, sf):
    has = lambda c, word: F.contains(F.col(c), F.lit(word))
    return rich_features(spark, sf).select(
        "page_id", has("main_text", "cookies").alias("cookie_in_main"), has("main_text", "hidden").alias("hidden_in_main"),
        has("main_text", "Embedded media: Demo video").alias("media_in_main"), has("main_text", "Facts & figures").alias("heading_in_main"),
        has("text", "cookies").alias("cookie_in_text"), F.length("footer_text").alias("footer_chars"),
    )


@query(rf"""
SELECT page_id, len(regexp_extract(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '(?s)<footer>(.*?)</footer>', 1)) AS footer_chars,
       len(regexp_extract_all(html, '<a href="')) - 1 + list_sum(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda t: len(t)))::BIGINT AS header_chars
FROM pages""")
def page_regions(spark, sf):
    return PF.with_full_markdown(features(spark, sf)).select(
        "page_id", F.col("content_regions.footer_chars").alias("footer_chars"), F.col("content_regions.header_chars").alias("header_chars")
    )


@query(rf"""
SELECT page_id, true AS titled, true AS has_schema_line, true AS has_table, true AS has_image, true AS has_links, page_id % 4 < 2 AS counts_blocks
FROM pages WHERE page_id % 4 <> 3
UNION ALL SELECT page_id, true, false, true, true, true, false FROM pages WHERE page_id % 4 = 3""")
def full_page_markdown(spark, sf):
    f = PF.with_full_markdown(rich_features(spark, sf))
    return f.select(
        "page_id", F.col("markdown").startswith(F.concat(F.lit("# "), F.substring_index("title", "\n", 1))).alias("titled"),
        F.contains(F.col("markdown"), F.lit("Schema types: ")).alias("has_schema_line"),
        F.contains(F.col("markdown"), F.lit("| Item | Value |")).alias("has_table"),
        F.contains(F.col("markdown"), F.lit("![Picture](")).alias("has_image"),
        F.contains(F.col("markdown"), F.lit("- [Spec](")).alias("has_links"),
        F.contains(F.col("markdown"), F.lit("JSON-LD blocks detected: 1")).alias("counts_blocks"),
    )


@query(rf"""
WITH l AS ({LINKS_SQL}), n AS (SELECT page_id, count(DISTINCT (link, label)) AS links FROM l GROUP BY 1)
SELECT page_id, url, 'html' AS resource_type, links + 1 AS links, 1 AS linked_pdfs, 2 AS images, page_id % 2 = 1 AS robots_indexable, page_id % 4 = 0 AS product_schema,
       page_id % 4 < 2 AS schema_json_ld, 1 AS hreflang_count, true AS consistent FROM pages LEFT JOIN n USING (page_id)""")
def page_manifest(spark, sf):
    f = PF.with_full_markdown(rich_features(spark, sf))
    success = F.col("crawl_status") == "success"
    return PF.page_manifest(f, status_code=F.lit(200)).select(
        "page_id", "url", "resource_type", F.size("links").alias("links"), F.size("linked_pdfs").alias("linked_pdfs"),
        F.size("images").alias("images"), "geo_signals.robots_indexable", "geo_signals.product_schema", "geo_signals.schema_json_ld",
        "geo_signals.hreflang_count",
        ((F.col("geo_analysis_ready") == success) & ((F.col("content_score_policy") == "score") == success)
         & (F.col("extraction_quality_score") >= 0.12)).alias("consistent"),
    )


# --- crawl --------------------------------------------------------------------------------

WORDS = count_sql("text", P.WORD + "+")


@query(rf"""
WITH d AS (SELECT doc_id, text, 'https://h.example/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.html' WHEN 2 THEN '/' ELSE '' END AS url,
            CASE WHEN doc_id % 7 = 0 THEN 'application/pdf; v=1' WHEN doc_id % 7 = 1 THEN 'image/png' ELSE 'text/html' END AS ct,
            CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 9 = 1 THEN split_part(text, chr(10), 1) ELSE text END AS body FROM documents)
SELECT doc_id, CASE WHEN (url LIKE '%.PDF' OR ct LIKE '%application/pdf%') AND body <> '' THEN 'success'
         WHEN url LIKE '%.PDF' OR ct LIKE '%application/pdf%' THEN 'empty_pdf_extract'
         WHEN {count_sql('body', P.WORD + '+')} >= 20 THEN 'success' ELSE 'empty_extract' END AS crawl_status,
       CASE WHEN NOT (ct LIKE '%html%' OR regexp_matches(lower(url), '(\.html|\.htm|/)$')) THEN 'skipped_non_html'
         WHEN body <> '' THEN 'success' ELSE 'empty_extract' END AS simple_status
FROM d""")
def crawl_status(spark, sf):
    n = F.col("doc_id")
    d = table(spark, sf, "documents").withColumns({
        "url": F.concat(F.lit("https://h.example/"), n.cast("string"),
                        F.when(n % 5 == 0, ".PDF").when(n % 5 == 1, ".html").when(n % 5 == 2, "/").otherwise("")),
        "ct": F.when(n % 7 == 0, "application/pdf; v=1").when(n % 7 == 1, "image/png").otherwise("text/html"),
        "body": F.when(n % 9 == 0, "").when(n % 9 == 1, F.split("text", "\n")[0]).otherwise(F.col("text")),
    })
    return d.select("doc_id", crawl.fetch_status("url", F.col("ct"), "body").alias("crawl_status"),
                    crawl.simple_fetch_status("url", F.col("ct"), "body").alias("simple_status"))


def metrics_ctes(source: str, c: str = "text") -> str:
    """Per document: the figures the quality score needs."""
    links = f"regexp_extract_all({c}, {quoted(M.LINK_TARGET)}, 1)"
    lines = f"string_split_regex({c}, '{P.LINE_BREAK}')"
    return f"""
SELECT *, len({c}) AS chars, {count_sql(c, re2(M.HEADING))} AS headings, len({links}) AS links, {count_sql(c, M.IMAGE_TARGET)} AS images,
       {numeric_count_sql(c)} AS numbers, len(list_filter({lines}, lambda ln: len(ln) - len(replace(ln, '|', '')) >= 2)) >= 3 AS table_like
FROM {source}"""


STRUCTURED = """'# ' || source || chr(10) || '## ' || lang || chr(10) || text || chr(10) || CASE WHEN doc_id % 2 = 0 THEN
  '### a' || chr(10) || '#### b' || chr(10) || '# c' || chr(10) || '[x](https://a.example/1) [y](https://a.example/2) [z](https://a.example/3)' || chr(10)
  || '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | 2 |' || chr(10) || '![i](https://a.example/i.png) 5 km 7 kW 9 % 11 L 13 m' ELSE '' END"""


def _structured(spark, sf):
    tail = (
        "### a\n#### b\n# c\n[x](https://a.example/1) [y](https://a.example/2) [z](https://a.example/3)\n"
        "| a | b |\n| - | - |\n| 1 | 2 |\n![i](https://a.example/i.png) 5 km 7 kW 9 % 11 L 13 m"
    )
    return table(spark, sf, "documents").withColumn("md", F.concat(
        F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text", F.lit("\n"),
        F.when(F.col("doc_id") % 2 == 0, tail).otherwise(""),
    ))


@query(rf"""
WITH d AS (SELECT doc_id, ({STRUCTURED}) AS md, CASE doc_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 301 ELSE 200 END AS code FROM documents),
m AS ({metrics_ctes('d', 'md')}),
p AS (SELECT *, CASE WHEN chars >= 2500 THEN 25 WHEN chars >= 1000 THEN 15 WHEN chars >= 400 THEN 5 ELSE 0 END
   + CASE WHEN headings >= 5 THEN 18 WHEN headings >= 2 THEN 10 ELSE 0 END + CASE WHEN links >= 10 THEN 15 WHEN links >= 3 THEN 8 ELSE 0 END
   + CASE WHEN images >= 3 THEN 10 WHEN images >= 1 THEN 3 ELSE 0 END + CASE WHEN numbers >= 5 THEN 10 WHEN numbers >= 1 THEN 4 ELSE 0 END
   + CASE WHEN table_like THEN 10 ELSE 0 END + CASE WHEN code >= 200 AND code < 300 THEN 12 ELSE 0 END AS points FROM m)
SELECT doc_id, least(100, points) / 100.0 AS score,
       CASE WHEN code = 403 THEN 'blocked' WHEN points >= 45 AND chars >= 900 THEN 'success' WHEN chars >= 300 THEN 'partial' ELSE 'failed' END AS status,
       code <> 403 AND points >= 45 AND chars >= 900 AS allowed
FROM p""")
def quality_score(spark, sf):
    code = F.when(F.col("doc_id") % 5 == 0, 403).when(F.col("doc_id") % 5 == 1, 301).otherwise(200)
    d = _structured(spark, sf).select("doc_id", M.markdown_metrics("md").alias("m"), code.alias("code"))
    q = d.select("doc_id", crawl.extraction_quality(F.col("m"), F.col("code")).alias("q"))
    return q.select("doc_id", F.col("q.extraction_quality_score").alias("score"), F.col("q.extraction_status").alias("status"),
                    F.col("q.scoring_allowed").alias("allowed"))


def _sparse_pages(spark, sf):
    """Crawled documents with gaps in text and status, as older payloads have them."""
    n = F.col("pos")
    return crawled(spark, sf).withColumns({
        "markdown": F.when(n % 10 == 3, F.lit(None).cast("string")).otherwise(F.col("markdown")),
        "snippet": F.when(n % 20 == 3, "short note"),
        "crawl_status": F.when(n % 6 == 0, "").otherwise(F.col("crawl_status")),
        "status_code": F.when(n % 3 == 0, 200),
        "extraction_status": F.when(n % 5 == 0, "pending"),
        "final_url": F.when(n % 4 == 1, F.concat("url", F.lit("?final"))),
    })


SPARSE_SQL = f"""
SELECT run_id, pos, url, CASE WHEN pos % 10 = 3 THEN NULL ELSE markdown END AS markdown, CASE WHEN pos % 20 = 3 THEN 'short note' END AS snippet,
       CASE WHEN pos % 6 = 0 THEN '' ELSE crawl_status END AS given, CASE WHEN pos % 3 = 0 THEN 200 END AS code,
       CASE WHEN pos % 5 = 0 THEN 'pending' END AS extraction, CASE WHEN pos % 4 = 1 THEN url || '?final' ELSE url END AS final_url
FROM ({CRAWLED_SQL})"""
ENRICHED_SQL = rf"""
t AS (SELECT *, CASE WHEN regexp_replace(coalesce(markdown, ''), '\s', '', 'g') <> '' THEN markdown ELSE coalesce(snippet, '') END AS txt FROM s),
c AS (SELECT *, {count_sql('txt', P.WORD_OR_CJK)} AS words,
        CASE WHEN given = 'success' AND len(txt) = 0 THEN 'partial_success_empty_text' WHEN given = '' AND len(txt) > 0 THEN 'success' ELSE given END AS status FROM t)"""


@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL}
SELECT pos, final_url, {HOST} AS domain, len(txt) AS text_chars, words AS word_count, status AS crawl_status, coalesce(code, -1) AS http_status_code,
       coalesce(CASE WHEN status = 'success' AND len(txt) > 0 THEN 'success' ELSE extraction END, '-') AS extraction_status,
       status = 'success' AND words >= 20 AS geo_analysis_ready,
       CASE WHEN status = 'success' AND words >= 20 THEN 'score' ELSE 'metadata_only_until_crawled' END AS content_score_policy,
       CASE WHEN status = 'success' AND words >= 20 THEN 'benchmark_score' ELSE 'citation_metadata_until_crawled' END AS external_policy,
       md5(coalesce(txt, '')) AS content_extract
FROM c""")
def page_enrichment(spark, sf):
    e = crawl.enrich_pages(_sparse_pages(spark, sf))
    x = crawl.enrich_pages(_sparse_pages(spark, sf).select("pos", "url", "markdown", "snippet", "crawl_status"), external=True)
    own = e.select(
        "pos", "final_url", "domain", "text_chars", "word_count", "crawl_status",
        F.coalesce("http_status_code", F.lit(-1)).alias("http_status_code"),
        F.coalesce("extraction_status", F.lit("-")).alias("extraction_status"), "geo_analysis_ready", "content_score_policy",
        F.md5(F.coalesce("content_extract", F.lit(""))).alias("content_extract"),
    )
    return own.join(x.select("pos", F.col("content_score_policy").alias("external_policy")), "pos")


COUNTERS_SQL = """count(*) FILTER (status NOT IN ('', 'not_requested', 'pending')) AS {0}attempted,
       count(*) FILTER (status = 'success') AS {0}crawled, count(*) FILTER (status IN ('failed', 'blocked', 'error', 'partial_success_empty_text')) AS {0}failed,
       count(*) FILTER (status = 'success' AND words >= 20) AS {0}scoreable"""


@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL}
SELECT run_id, count(*) AS candidates, {COUNTERS_SQL.format('')} FROM c GROUP BY run_id""")
def crawl_counters(spark, sf):
    return crawl.crawl_counters(crawl.enrich_pages(_sparse_pages(spark, sf)), "run_id")


@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL},
k AS (SELECT *, pos % 3 <> 0 AS own FROM c),
r AS (SELECT run_id,
  count(*) FILTER (own) AS owned_page_candidates, count(*) FILTER (NOT own) AS external_page_candidates,
  count(*) FILTER (own AND status NOT IN ('', 'not_requested', 'pending')) AS owned_pages_attempted,
  count(*) FILTER (NOT own AND status NOT IN ('', 'not_requested', 'pending')) AS external_pages_attempted,
  count(*) FILTER (own AND status = 'success') AS owned_pages_crawled, count(*) FILTER (NOT own AND status = 'success') AS external_pages_crawled,
  count(*) FILTER (own AND status IN ('failed', 'blocked', 'error', 'partial_success_empty_text')) AS owned_pages_failed,
  count(*) FILTER (NOT own AND status IN ('failed', 'blocked', 'error', 'partial_success_empty_text')) AS external_pages_failed,
  count(*) FILTER (own AND status = 'success' AND words >= 20) AS owned_pages_scoreable,
  count(*) FILTER (NOT own AND status = 'success' AND words >= 20) AS external_pages_scoreable FROM k GROUP BY run_id)
SELECT *, coalesce((SELECT sum(pos % 4)::BIGINT FROM k WHERE k.run_id = r.run_id), 0) AS external_citation_count,
  CASE WHEN owned_pages_attempted + external_pages_attempted > 0 THEN
    round_even((owned_pages_crawled + external_pages_crawled)::DOUBLE / (owned_pages_attempted + external_pages_attempted), 4) END AS crawl_success_rate
FROM r""")
def run_telemetry(spark, sf):
    p = crawl.enrich_pages(_sparse_pages(spark, sf)).withColumn("kind", F.when(F.col("pos") % 3 != 0, "owned").otherwise("external"))
    cites = table(spark, sf, "documents").select(F.col("source").alias("run_id"), (F.col("doc_id") % 4).alias("citation_count"))
    return crawl.run_telemetry(p, cites)


# The same figures in SQL of another form.
@query(rf"""
WITH s AS ({SPARSE_SQL}), {ENRICHED_SQL},
k AS (SELECT *, pos % 3 <> 0 AS own, status NOT IN ('', 'not_requested', 'pending') AS tried, status = 'success' AS ok,
  status IN ('failed', 'blocked', 'error', 'partial_success_empty_text') AS bad FROM c)
SELECT run_id, {", ".join(
    f"count(*) FILTER ({test}) AS {side}_{name}" for side, own in (("owned", "own"), ("external", "NOT own")) for name, test in (
        ("page_candidates", own), ("pages_attempted", f"{own} AND tried"), ("pages_crawled", f"{own} AND ok"),
        ("pages_failed", f"{own} AND bad"), ("pages_scoreable", f"{own} AND ok AND words >= 20")))},
  sum(pos % 4)::BIGINT AS external_citation_count,
  CASE WHEN bool_or(tried) THEN round_even(count(*) FILTER (ok)::DOUBLE / count(*) FILTER (tried), 4) END AS crawl_success_rate
FROM k GROUP BY run_id""")
def run_telemetry_all_citations(spark, sf):
    return run_telemetry(spark, sf)


@query(rf"""
WITH d AS (SELECT source AS run_id, CASE doc_id % 5 WHEN 0 THEN 'weak' WHEN 1 THEN 'blocked' WHEN 2 THEN 'partial' ELSE 'success' END AS s FROM documents)
SELECT run_id, count(*) AS pages_requested, count(*) FILTER (s = 'success') AS pages_collected, count(*) FILTER (s IN ('weak', 'partial')) AS pages_weak,
       count(*) FILTER (s = 'blocked') AS pages_failed, CASE WHEN count(*) FILTER (s = 'blocked') > 0 THEN 'partial' ELSE 'success' END AS status
FROM d GROUP BY 1""")
def collection_summary(spark, sf):
    n = F.col("doc_id") % 5
    d = table(spark, sf, "documents").select(
        F.col("source").alias("run_id"),
        F.when(n == 0, "weak").when(n == 1, "blocked").when(n == 2, "partial").otherwise("success").alias("crawl_status"),
    )
    return crawl.collection_summary(d, "run_id")


# --- readiness ----------------------------------------------------------------------------

def _ready_input(spark, sf):
    n = F.col("pos")
    return crawled(spark, sf).withColumns({
        "markdown": F.concat("markdown", F.when(n % 3 == 0, " Official warranty of 5 年, 300 km, 40 kW, safety. FAQ? Updated 2024").otherwise("")),
        "meta_description": F.when(n % 2 == 0, "About this page"),
        "headings": F.when(n % 5 != 0, F.array_repeat(F.lit("h"), (n % 5).cast("int"))),
        "schema_types": F.when(n % 4 == 0, F.array(F.lit("Product"), F.lit("Offer"))).when(n % 4 == 1, F.array(F.lit("FAQPage"))),
        "json_ld_present": F.col("pos") % 4 == 0,
        "canonical_url": F.when(n % 2 == 1, F.col("url")),
    })


READY_SQL = f"""
SELECT run_id, pos, url, title, markdown || CASE WHEN pos % 3 = 0 THEN ' Official warranty of 5 年, 300 km, 40 kW, safety. FAQ? Updated 2024' ELSE '' END AS md,
       CASE WHEN pos % 2 = 0 THEN 'About this page' ELSE '' END AS descr, pos % 5 AS hs, CASE pos % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS types,
       pos % 4 = 0 AS ld, pos % 2 = 1 AS canon, crawl_status FROM ({CRAWLED_SQL})"""


def occurrences_sql(c: str, terms) -> str:
    return " + ".join(f"(len({c}) - len(replace({c}, {quoted(t)}, ''))) // {len(t)}" for t in terms)


SCORED_SQL = rf"""
a AS (SELECT *, title || chr(10) || descr || chr(10) || md AS comb FROM s),
b AS (SELECT *, lower(comb) AS low, {count_sql('comb', P.NOT_WS + '+')} AS words, {count_sql('comb', re2(R.NUMERIC_EVIDENCE))} AS nums,
        regexp_matches(comb, {quoted(re2(R.FRESHNESS_EVIDENCE))}) AS fresh FROM a),
e AS (SELECT *, {occurrences_sql('low', R.QUESTION_TERMS)} AS qs, {occurrences_sql('low', R.PROOF_TERMS)} AS proofs, words >= 250 AND len(md) >= 500 AS rich FROM b),
g AS (SELECT *, least(20, CASE WHEN ld THEN 12 ELSE 0 END + least(8, types * 3)) AS structured_data,
   CASE WHEN rich THEN 4 * ((title <> '')::INT + (descr <> '')::INT + (words >= 300)::INT + (hs >= 2)::INT) ELSE 4 * (title <> '')::INT END AS content_clarity,
   CASE WHEN rich THEN least(20, 4 * ((words >= 600)::INT + (words >= 1200)::INT) + least(6, nums) + least(4, hs)) ELSE 0 END AS semantic_depth,
   CASE WHEN rich THEN least(20, 2 + least(8, proofs) + least(6, nums) + 4 * fresh::INT) ELSE 2 END AS eeat_signals,
   CASE WHEN rich THEN 4 + 8 * fresh::INT + 4 * canon::INT ELSE 4 * canon::INT END AS freshness_index,
   CASE WHEN rich THEN least(12, qs * 3) ELSE 0 END AS faq_readiness FROM e),
z AS (SELECT *, content_clarity + semantic_depth + structured_data + eeat_signals + freshness_index + faq_readiness AS score FROM g)"""


@query(rf"""
WITH s AS ({READY_SQL}), {SCORED_SQL}
SELECT pos, score, content_clarity, semantic_depth, structured_data, eeat_signals, freshness_index, faq_readiness,
       CASE WHEN rich THEN 'crawl_evidence_v1' ELSE 'fallback_limited_v1' END AS method FROM z""")
def readiness_score(spark, sf):
    p = _ready_input(spark, sf)
    r = p.select("pos", R.readiness(p).alias("r"))
    return r.select("pos", "r.score", "r.dimensions.*", "r.method")


@query(rf"""
WITH s AS ({READY_SQL}), {SCORED_SQL},
c AS (SELECT run_id, pos, CASE WHEN pos % 6 = 1 THEN (pos % 90)::DOUBLE WHEN pos % 6 = 2 THEN 0.0 ELSE score END AS sc0, score, pos % 4 = 3 AS mapped FROM z),
f AS (SELECT run_id, pos, CASE WHEN sc0 = 0 THEN CASE WHEN pos % 6 = 2 AND pos % 12 = 2 THEN 0.0 ELSE score END ELSE sc0 END AS final, mapped, sc0, pos % 12 = 2 AS dims FROM c)
SELECT run_id, count(*) AS owned_pages_scoreable, count(*) FILTER (mapped) AS owned_query_mapped_unique, sum(final)::BIGINT AS score_sum,
       count(*) FILTER (pos % 6 = 1 AND pos % 90 <> 0 OR dims) AS explicit_rows
FROM f GROUP BY 1""")
def readiness_rollup(spark, sf):
    n = F.col("pos")
    p = _ready_input(spark, sf).withColumns({
        "current_geo_score_120": F.when(n % 6 == 1, (n % 90).cast("double")).when(n % 6 == 2, 0.0),
        "geo_dimensions": F.when(n % 12 == 2, F.create_map(F.lit("content_clarity"), F.lit(25.4), F.lit("semantic_depth"), F.lit(-1.0))),
        "mapped": n % 4 == 3,
    })
    rows = R.canonical_rows(p, "mapped")
    roll = R.readiness_rollup(rows, "run_id")
    extra = rows.groupBy("run_id").agg(
        F.sum("current_geo_score_120").cast("bigint").alias("score_sum"),
        F.count_if(F.col("scoring_method") == R.METHOD_EXPLICIT).alias("explicit_rows"),
    )
    return roll.join(extra, "run_id")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::VARCHAR AS shipped,
       greatest(0, least(20, round_even(l_quantity - 10, 0)))::INT AS clarity, greatest(0, least(20, round_even(l_discount * 200 + 0.25, 0)))::INT AS depth
FROM lineitem""")
def clamped_dimensions(spark, sf):
    dims = F.create_map(F.lit("clarity"), F.col("l_quantity") - 10, F.lit("depth"), F.col("l_discount") * 200 + 0.25)
    li = table(spark, sf, "lineitem").withColumn("d", R.clamp_dimensions(dims))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("shipped"),
                     F.col("d")["clarity"].alias("clarity"), F.col("d")["depth"].alias("depth"))


# --- text scores and signals --------------------------------------------------------------

SCORING = f"({STRUCTURED}) || chr(10) || '# Is the ' || source || ' page good in ' || lang || '?' || chr(10) || 'Last updated ' || n_chars || ' km'"
TOKEN_RE = f"[{P.TOKEN_CHARS}{P.PROLONGED_MARK}]+"


def _scored(spark, sf, **kw):
    d = _structured(spark, sf).withColumn("body", F.concat(
        "md", F.lit("\n# Is the "), "source", F.lit(" page good in "), "lang", F.lit("?\nLast updated "), F.col("n_chars").cast("string"), F.lit(" km")))
    q = F.concat(F.lit("the "), "source", F.lit(" of "), "lang", F.lit(" km prices"))
    return d.select("doc_id", X.text_scores("body", q, **kw).alias("s"))


def keywords_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '{TOKEN_RE}'), lambda t: len(t) > 1 AND NOT list_contains([{in_list(T.STOP_WORDS)}], t)))"


TEXT_SCORE_SQL = rf"""
d AS (SELECT doc_id, {SCORING} AS raw, 'the ' || source || ' of ' || lang || ' km prices' AS q FROM documents),
c AS (SELECT *, {clean_sql('raw')} AS t FROM d),
k AS (SELECT *, {keywords_sql('q')} AS qt, {keywords_sql("t || '  '")} AS tt, lower(t) AS low FROM c),
m AS (SELECT *, {count_sql('t', X.WORDS)} AS words, len(list_intersect(qt, tt)) AS ov, left(low, 1200) AS fb,
   len(list_filter(list_transform(regexp_extract_all(t, '(?m)^#{{1,4}}\s+(.+)$', 1), lambda h: {compact_sql('h')}), lambda h: len(h) > 2)) AS hs,
   len(list_distinct({questions_sql('t')})) AS qn,
   len(list_distinct(list_transform(list_filter(regexp_extract_all(t, {quoted(NUMBER_RE2)}), lambda x: NOT regexp_matches(lower(x), '{M.NUMBER_NOISE}')), lambda x: trim(x)))) AS n,
   len(list_filter(string_split(t, chr(10)), lambda ln: len(ln) - len(replace(ln, '|', '')) >= 2)) >= 3 AS tables FROM k),
e AS (SELECT *, ov::DOUBLE / greatest(1, least(len(qt), 12)) AS ratio,
   ov >= 2 AND len(fb) > 250 AND list_bool_or(list_transform(qt, lambda x: contains(fb, x))) AS direct FROM m),
f AS (SELECT *,
   CASE WHEN direct AND n >= 2 THEN 5 WHEN direct THEN 3 WHEN ov > 0 THEN 1 ELSE 0 END AS answer_first,
   CASE WHEN ratio >= 0.55 THEN 5 WHEN ratio >= 0.38 THEN 4 WHEN ratio >= 0.25 THEN 3 WHEN ov >= 2 THEN 2 WHEN ov > 0 THEN 1 ELSE 0 END AS query_relevance,
   (hs >= 2)::INT + (words >= 300)::INT + (words >= 900)::INT + (qn >= 2)::INT + tables::INT AS extractable_passages,
   CASE WHEN n >= 8 AND ov >= 2 THEN 5 WHEN n >= 5 AND ov >= 1 THEN 4 WHEN n >= 3 THEN 3 WHEN n > 0 THEN 1 ELSE 0 END AS specific_facts,
   CASE WHEN n >= 10 THEN 5 WHEN n >= 7 THEN 4 WHEN n >= 5 THEN 3 WHEN n > 0 THEN 1 ELSE 0 END AS statistics,
   0 AS source_citations, CASE WHEN tables THEN 3 ELSE 0 END AS comparison_readiness,
   CASE WHEN qn >= 5 THEN 5 WHEN qn >= 3 THEN 4 WHEN qn > 0 THEN 2 ELSE 0 END AS faq_readiness,
   CASE WHEN contains(lower(raw), 'application/ld+json') OR contains(lower(raw), 'schema.org') THEN 5 ELSE 0 END AS schema,
   CASE WHEN regexp_matches(t, {quoted(re2(X.RECENT))}) THEN 4 WHEN regexp_matches(t, {quoted(X.OLDER)}) THEN 2 ELSE 0 END AS freshness,
   5 AS neutral_tone, 0 AS authority_signals,
   CASE WHEN words >= 1000 THEN 5 WHEN words >= 600 THEN 4 WHEN words >= 300 THEN 3 WHEN words >= 80 THEN 1 ELSE 0 END AS accessibility FROM e)"""
FEATURE_SUM = " + ".join(X.FEATURES)


@query(rf"""
WITH {TEXT_SCORE_SQL}, g AS (SELECT *, greatest(0, least(100, round_even(({FEATURE_SUM}) / 65.0::DOUBLE * 100, 0)))::INT AS score FROM f)
SELECT doc_id, score, round_even(score * 1.2::DOUBLE, 0)::INT AS geo_score_120, words AS word_count, {", ".join(X.FEATURES)},
       CASE WHEN round_even(score * 1.2::DOUBLE, 0) >= 90 THEN 'likely cited' WHEN round_even(score * 1.2::DOUBLE, 0) >= 60 THEN 'occasionally cited' ELSE 'rarely cited' END AS outlook
FROM g""")
def text_feature_scores(spark, sf):
    return _scored(spark, sf).select(
        "doc_id", "s.score", "s.geo_score_120", "s.word_count", "s.features.*", F.col("s.citation_likelihood").alias("outlook"))


PROMOTIONAL_TERMS = ("the", "ing", "ion", "best", "amazing")
FEATURE_WEIGHTS = {"answer_first": 2, "query_relevance": 1.5, "statistics": 0.5, "schema": 0}
PENALTY_WEIGHTS = {"promotional_language_penalty": 1.5, "noise_penalty": 2}
CLARITY = {"content_clarity": {"max": 30, "feature_weights": {"answer_first": 2, "extractable_passages": 2, "neutral_tone": 1}}}
_weights = {k: float(FEATURE_WEIGHTS.get(k, 1.0)) for k in X.FEATURES}
_toned = lambda k: "(5 - promo)" if k == "neutral_tone" else k


@query(rf"""
WITH {TEXT_SCORE_SQL}, p AS (SELECT *, {" + ".join(f"contains(low, {quoted(t)})::INT" for t in PROMOTIONAL_TERMS)} AS promo FROM f),
g AS (SELECT *, greatest(0, least(100, round_even((0.0::DOUBLE + {" + ".join(f"{_toned(k)} * {w}::DOUBLE" for k, w in _weights.items())} - promo * 1.5::DOUBLE)
        / {5 * sum(_weights.values())}::DOUBLE * 100, 0)))::INT AS score,
   greatest(0, least(30, round_even((0.0::DOUBLE + answer_first / 5.0::DOUBLE * 2.0::DOUBLE + extractable_passages / 5.0::DOUBLE * 2.0::DOUBLE + (5 - promo) / 5.0::DOUBLE * 1.0::DOUBLE)
        / 5.0::DOUBLE * 30, 0)::INT - least(3, promo))) AS content_clarity FROM p)
SELECT doc_id, score, round_even(score * 1.2::DOUBLE, 0)::INT AS geo_score_120, promo AS promotion, content_clarity, 30 AS clarity_max FROM g""")
def weighted_text_scores(spark, sf):
    """Scores with weights of features and penalties, and a dimension with a highest score of its own."""
    terms = {"promotional_terms": PROMOTIONAL_TERMS}
    plain = _scored(spark, sf, heuristics=terms, feature_weights=FEATURE_WEIGHTS, penalty_weights=PENALTY_WEIGHTS)
    clarity = _scored(spark, sf, heuristics=terms, dimensions=CLARITY).select("doc_id", F.col("s.dimension_scores")[0].alias("c"))
    return plain.join(clarity, "doc_id").select(
        "doc_id", "s.score", "s.geo_score_120", F.col("s.penalties.promotional_language_penalty").alias("promotion"),
        F.col("c.score").alias("content_clarity"), F.col("c.max").alias("clarity_max"))


def dimension_sql(name: str) -> str:
    weights = X.EXAMPLE_DIMENSIONS[name]
    total = float(sum(weights.values()))
    terms = " + ".join(f"{k} / 5.0::DOUBLE * {float(w)}::DOUBLE" for k, w in weights.items())
    return f"greatest(0, least(20, round_even((0.0::DOUBLE + {terms}) / {total}::DOUBLE * 20, 0)::INT))"


@query(rf"""
WITH {TEXT_SCORE_SQL}, g AS (SELECT doc_id, unnest([{", ".join(f"{{'dimension': '{n}', 'score': {dimension_sql(n)}}}" for n in X.EXAMPLE_DIMENSIONS)}]) AS d FROM f)
SELECT doc_id, d.dimension AS dimension, d.score AS score,
       CASE WHEN d.score <= 5 THEN 'weak_or_not_observed' WHEN d.score <= 10 THEN 'basic_limited' WHEN d.score <= 15 THEN 'adequate_incomplete' ELSE 'strong_citation_ready' END AS band
FROM g""")
def text_dimension_scores(spark, sf):
    return _scored(spark, sf, dimensions=X.EXAMPLE_DIMENSIONS).select("doc_id", F.explode_outer("s.dimension_scores").alias("d")).select(
        "doc_id", "d.dimension", "d.score", "d.band")


_has = lambda terms: "(" + " OR ".join(f"contains(lower(t), {quoted(x)})" for x in terms) + ")"


@query(rf"""
WITH d AS (SELECT doc_id, {block_sql('(' + STRUCTURED + ')')} AS t FROM documents),
m AS ({metrics_ctes('d', 't')}),
n AS (SELECT *, len(list_distinct(list_filter(list_transform(string_split_regex(t, '{P.LINE_BREAK}'), lambda ln: {line_key_sql('ln')}), lambda k: k <> ''))) AS uniq,
   {count_sql('t', M.QUESTION_SPAN)} AS qs, {count_sql('lower(t)', S.NOISE_TERMS)} AS noise, {count_sql('lower(t)', S.CONTENT_TERMS)} AS content FROM m)
SELECT doc_id, t <> '' AND headings >= 1 AND ({_has(S.DOMAIN_TERMS)} OR chars > 400) AS answer_first, headings >= 2 AS headings_present,
   headings >= 2 AND uniq >= 15 AND chars >= 900 AS extractable_passages, {_has(S.FAQ_TERMS)} OR qs >= 2 AS faq_like,
   {_has(S.COMPARISON_TERMS)} AS comparison_terms, {_has(S.ACTION_TERMS)} AS actionable_terms, {_has(S.DOMAIN_TERMS)} AS domain_specific_terms,
   numbers >= 5 AS key_facts, links >= 3 OR {_has(S.CITATION_TERMS)} AS source_citations, links >= 3 AS internal_links, links >= 1 AS external_links,
   {_has(S.DOCUMENT_TERMS)} AS pdf_or_spec_links, images >= 3 AS image_alt_evidence, doc_id % 3 = 0 AS product_schema, doc_id % 2 = 0 AS robots_indexable,
   {_has(S.FRESHNESS_TERMS)} AS freshness_signals, {_has(S.CTA_TERMS)} AS cta_links, doc_id % 300 > 50 AS footer_present,
   links >= 3 OR {_has(S.CITATION_TERMS)} OR {_has(S.DOCUMENT_TERMS)} OR doc_id % 300 > 200 AS authority_signals,
   noise AS nav_noise_terms, content AS content_terms, round_even(noise::DOUBLE / greatest(1, content), 2) AS noise_ratio,
   round_even(noise::DOUBLE / greatest(1, content), 2) <= 0.4 AS low_noise_ratio
FROM n""")
def geo_signals(spark, sf):
    types = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("PRODUCT")))
    robots = F.when(F.col("doc_id") % 2 == 1, "NoIndex, follow")
    d = _structured(spark, sf).select("doc_id", S.evidence_signals(
        "md", schema_types=types, robots=robots, footer_chars=(F.col("doc_id") % 300).cast("int")).alias("g"))
    names = (
        "answer_first", "headings_present", "extractable_passages", "faq_like", "comparison_terms", "actionable_terms",
        "domain_specific_terms", "key_facts", "source_citations", "internal_links", "external_links", "pdf_or_spec_links",
        "image_alt_evidence", "product_schema", "robots_indexable", "freshness_signals", "cta_links", "footer_present",
        "authority_signals", "nav_noise_terms", "content_terms", "noise_ratio", "low_noise_ratio",
    )
    return d.select("doc_id", *[f"g.{n}" for n in names])


# --- hygiene ------------------------------------------------------------------------------

def _html_pages(spark, sf):
    f = rich_features(spark, sf).withColumn("crawl_status", crawl.fetch_status("url", F.lit("text/html"), F.col("main_text")))
    return f.select(U.site_domain(U.host("url")).alias("run_id"), F.col("page_id").alias("pos"), "url", T.compact("title").alias("title"),
                    "json_ld_present", "json_ld_block_count", "schema_types", "schema_types_detected", "crawl_status")


MARKED_SQL = rf"""
SELECT page_id, array_to_string(string_split({AUTH}, '.')[-2:], '.') AS run_id, page_id AS pos, url, {decoded(compact_sql(TITLE_SQL))} AS title, page_id % 4 < 3 AS ld,
   CASE page_id % 4 WHEN 0 THEN ['Product', 'Offer'] WHEN 1 THEN ['FAQPage', 'WebPage', 'Question'] WHEN 2 THEN ['Broken'] ELSE [] END AS types FROM pages"""


COVERAGE_SQL = f"""
SELECT run_id, count(*) AS owned_pages_total, count(*) FILTER (ld OR len(types) > 0) AS pages_with_schema, count(*) FILTER (ld) AS pages_with_json_ld,
       round_even(count(*) FILTER (ld)::DOUBLE / count(*) * 100, 1) AS coverage_pct, true AS structured_checked FROM ({MARKED_SQL}) GROUP BY 1"""


@query(COVERAGE_SQL)
def hygiene_coverage(spark, sf):
    return H.structured_coverage(_html_pages(spark, sf), "run_id")


@query(f"""
WITH t AS (SELECT run_id, pos, unnest(types) AS schema_type, generate_subscripts(types, 1) AS i FROM ({MARKED_SQL})),
c AS (SELECT run_id, schema_type, count(*) AS pages, min(pos * 100 + i) AS f FROM t GROUP BY 1, 2)
SELECT run_id, schema_type, pages, row_number() OVER (PARTITION BY run_id ORDER BY pages DESC, f) AS rank FROM c""")
def schema_type_counts(spark, sf):
    return H.schema_type_counts(_html_pages(spark, sf), "run_id")


@query(f"SELECT run_id, pos, url, coalesce(nullif(title, ''), '-') AS title FROM ({MARKED_SQL}) WHERE NOT ld")
def missing_json_ld(spark, sf):
    found = H.missing_json_ld(_html_pages(spark, sf), "run_id")
    return found.select("run_id", "pos", "url", F.coalesce(F.nullif("title", F.lit("")), F.lit("-")).alias("title"))


@query(f"""
WITH h AS (SELECT *, CASE WHEN run_id LIKE '%.com' THEN 'available' ELSE 'not found' END AS robots_status,
    CASE WHEN run_id LIKE '%.org' THEN 'not checked' ELSE 'not found' END AS llms_status FROM ({COVERAGE_SQL}))
SELECT run_id, robots_status, llms_status,
  CASE WHEN llms_status = 'not checked' OR coverage_pct < 50 THEN 'high' WHEN coverage_pct < 80 THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN llms_status = 'not checked' THEN {quoted(H.NOT_FULLY_CHECKED_SUMMARY)} ELSE
    'JSON-LD/schema coverage: ' || pages_with_json_ld || '/' || owned_pages_total || ' owned pages (' ||
    CASE WHEN coverage_pct = floor(coverage_pct) THEN coverage_pct::BIGINT::VARCHAR ELSE coverage_pct::VARCHAR END || '%). Robots.txt '
    || CASE WHEN robots_status = 'available' THEN 'is available' ELSE 'was not found' END || '; LLMs.txt was not found.' END AS summary
FROM h""")
def hygiene_priority(spark, sf):
    return _priority(_html_pages(spark, sf))


def _priority(pages):
    c = H.structured_coverage(pages, "run_id")
    robots = H.file_status(F.when(F.col("run_id").endswith(".com"), " Fetched ").otherwise("not_requested"),
                           F.when(F.col("run_id").endswith(".com"), 0).otherwise(2))
    llms = H.file_status(F.when(F.col("run_id").endswith(".org"), "pending").otherwise("404"))
    return H.hygiene(c, robots, llms).select("run_id", "robots_status", "llms_status", "priority", "summary")


@query(f"""
SELECT run_id, CASE WHEN run_id LIKE '%.com' THEN 'stored' WHEN run_id LIKE '%.net' THEN 'nested' ELSE 'recomputed' END AS origin,
       owned_pages_total AS pages FROM ({COVERAGE_SQL})""")
def hygiene_source(spark, sf):
    return _source(_html_pages(spark, sf))


def _source(pages):
    c = H.structured_coverage(pages, "run_id")
    full = H.hygiene(c, F.lit("available"), F.lit("available"))
    stored = full.withColumn("summary", F.when(F.col("run_id").endswith(".com"), F.col("summary"))).withColumn("origin", F.lit("stored"))
    nested = full.where(~F.col("run_id").endswith(".org")).withColumn("origin", F.lit("nested"))
    best = H.hygiene_by_source(stored, nested, full.withColumn("origin", F.lit("recomputed")))
    return best.select("run_id", "origin", F.col("owned_pages_total").alias("pages"))


# The names under which these queries first read the markup.
@query(ORACLE["hygiene_coverage"])
def html_hygiene_coverage(spark, sf):
    return hygiene_coverage(spark, sf)


@query(ORACLE["schema_type_counts"])
def html_schema_type_counts(spark, sf):
    return schema_type_counts(spark, sf)


@query(ORACLE["missing_json_ld"])
def html_missing_json_ld(spark, sf):
    return missing_json_ld(spark, sf)


@query(ORACLE["hygiene_priority"])
def html_hygiene_priority(spark, sf):
    return hygiene_priority(spark, sf)


@query(ORACLE["hygiene_source"])
def html_hygiene_source(spark, sf):
    return hygiene_source(spark, sf)


@query(rf"""
SELECT regexp_replace({AUTH}, '^www\.', '') AS host, count(*) AS pages, 0 AS pages_with_json_ld, 'high' AS priority,
       count(*) FILTER (regexp_matches(html, '<title>\s*</title>')) AS untitled, count(*) AS pages_scored
FROM pages WHERE regexp_matches({AUTH}, '(^|\.)example\.(com|org)$') GROUP BY 1""")
def hygiene_readiness_by_host(spark, sf):
    """The flagship: owned pages → HTML features → coverage, priority and readiness per host."""
    owned = table(spark, sf, "pages").where(U.matches_any_domain(U.authority("url"), list(OWNED)))
    f = PF.page_features(owned).withColumns({"host": U.host("url"), "crawl_status": F.lit("success")})
    f = f.withColumn("headings", F.transform("headings", lambda h: F.concat(h["level"], h["text"])))
    flags = H.with_structured_flags(f.withColumn("r", R.readiness(f)))
    out = flags.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if("_json_ld").alias("pages_with_json_ld"),
        F.count_if(F.col("title") == "").alias("untitled"),
        F.count_if(F.col("r.score").between(0, R.SCALE)).alias("pages_scored"),
        (F.count_if("_json_ld") / F.count("*") * 100).alias("_pct"), F.bool_or("_signal").alias("_checked"),
    )
    return out.select("host", "pages", "pages_with_json_ld", "untitled", "pages_scored",
                      H.priority(F.col("_pct"), F.lit("available"), F.lit("available"), F.col("_checked")).alias("priority"))
