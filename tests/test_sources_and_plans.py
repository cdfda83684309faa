"""Readers and sinks on files, and the three plans end to end on small evidence."""

import json

import pytest
from pyspark.sql import functions as F

from citegrain.operators import citations as C
from citegrain.operators import json_walks as J, registry
from citegrain.plans import compact, refresh
from citegrain.sources import artifacts as A, exports as X, pages as P, sitemaps as M


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_read_artifact_skips_missing_and_corrupt(spark, tmp_path):
    put(tmp_path / "r1" / "owned.json", json.dumps({"pages": [{"url": "https://a/"}]}, indent=1))
    put(tmp_path / "r2" / "owned.json", "{broken")
    (tmp_path / "r3").mkdir()
    schema = "pages array<struct<url:string>>"
    rows = A.read_artifact(spark, str(tmp_path), "owned", schema).collect()
    assert [(r.run_id, r.pages[0].url) for r in rows] == [("r1", "https://a/")]
    kept = A.read_artifact(spark, str(tmp_path), "owned", schema, keep_corrupt=True)
    assert sorted(r.run_id for r in kept.collect()) == ["r1", "r2"]


def test_locate_artifacts_prefers_first_candidate(spark, tmp_path):
    root = tmp_path / "seed"
    put(root / "r1" / "inputs" / "audit_context.json", "{}")
    put(root / "r1" / "outputs" / "audit_context" / "audit_context.json", "{}")
    put(root / "r2" / "inputs" / "audit_context.json", "{}")
    put(root / "r2" / "other.json", "{}")
    found = A.locate_artifacts(A.list_files(spark, str(root)), str(root))
    got = {(r.run_id, r.artifact): r.path.split("/seed/")[1] for r in found.collect()}
    assert got == {("r1", "audit_context"): "r1/outputs/audit_context/audit_context.json", ("r2", "audit_context"): "r2/inputs/audit_context.json"}
    state = {r.run_id: (r.status, len(r.missing)) for r in registry.completeness(found).collect()}
    assert state == {"r1": ("incomplete", 6), "r2": ("incomplete", 6)}


def test_write_artifact_replaces_only_its_runs(spark, tmp_path):
    path = str(tmp_path / "out")
    A.write_artifact(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int"), path)
    A.write_artifact(spark.createDataFrame([("r2", 3)], "run_id string, v int"), path)
    assert {(r.run_id, r.v) for r in spark.read.parquet(path).collect()} == {("r1", 1), ("r2", 3)}


SITEMAPS = [
    ("https://s/sitemap.xml", "<sitemapindex><sitemap><loc>https://s/a.xml?x=1&amp;y=2</loc></sitemap><sitemap><loc>https://s/b.XML</loc></sitemap><sitemap><loc>https://s/sitemap.xml</loc></sitemap></sitemapindex>"),
    ("https://s/a.xml?x=1&y=2", '<?xml version="1.0"?><urlset xmlns="http://x" xmlns:image="http://y"><!-- <loc>https://no/</loc> --><url><loc>\n https://s/1 </loc><image:loc>https://s/i.png</image:loc></url><url><loc><![CDATA[https://s/2]]></loc></url><url><loc>ftp://s/</loc></url></urlset>'),
    ("https://s/b.XML", "<urlset><url><loc>https://s/1</loc></url><url><loc>https://s/3</loc></url><url><loc>https://s/c.xml</loc></url></urlset>"),
    ("https://s/c.xml", "<urlset><url>"),
]


def read_site(spark, **limits):
    files = spark.createDataFrame([("s", u, c) for u, c in SITEMAPS], "site string, sitemap_url string, content string")
    sites = spark.createDataFrame([("s", "https://s", None)], "site string, domain string, explicit_sitemap_url string")
    parsed = M.parse_sitemaps(files)
    expand = {k: v for k, v in limits.items() if k == "max_expanded"}
    order = M.read_order(parsed, M.sitemap_candidates(sites), **expand)
    return M.site_inventory(parsed, order, **limits)


def test_nested_sitemaps_in_reading_order(spark):
    urls, stats = read_site(spark)
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://s/1", "https://s/i.png", "https://s/2", "https://s/3"]
    by_url = {r.sitemap_url: (r.idx, r.status, r.loc_count, r.url_count) for r in stats.collect()}
    assert by_url["https://s/sitemap.xml"] == (1, "success", 3, 0)
    assert by_url["https://s/a.xml?x=1&y=2"] == (6, "success", 4, 3)
    assert by_url["https://s/c.xml"] == (8, "error", 0, 0)
    assert by_url["https://s/sitemap_index.xml"][1] == "error"


def test_sitemap_limits(spark):
    urls, stats = read_site(spark, max_urls=2)
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://s/1", "https://s/i.png"]
    assert "https://s/b.XML" not in [r.sitemap_url for r in stats.collect()]
    urls, _ = read_site(spark, max_expanded=1)  # nothing may be expanded: nested files count as pages
    assert [r.url for r in urls.orderBy("pos").collect()] == ["https://s/a.xml?x=1&y=2", "https://s/b.XML", "https://s/sitemap.xml"]


def test_sites_without_sitemaps_fall_back(spark):
    sites = spark.createDataFrame([("s", "https://s"), ("t", "https://t/")], "site string, domain string")
    rows = M.with_fallback(read_site(spark)[0], sites).collect()
    assert sum(r.fallback_used for r in rows) == 8 and {r.site for r in rows if r.fallback_used} == {"t"}


def test_robots_directives(spark):
    files = spark.createDataFrame([("s", "User-agent: *\nSiteMap: https://s/x.xml:1 \r\n sitemap: https://no\nsitemap:\n")], "site string, content string")
    assert [(r.pos, r.sitemap_url) for r in M.robots_sitemaps(files).collect()] == [(1, "https://s/x.xml:1")]


def test_portfolio_envelopes(spark, tmp_path):
    good = {"schema_version": "brand_topic_query_portfolio.v1", "brand": "A &amp; B", "topics": ["EV"], "queries": ["best &lt;EV&gt;", {"query": "second", "query_id": "x"}]}
    files = {
        "plain": json.dumps(good), "fenced": "```json\n" + json.dumps(good) + "\n```", "twice": json.dumps(json.dumps(good)),
        "wrapped": json.dumps({"data": {"response": json.dumps(good)}}), "inside": json.dumps({"portfolio": good}),
        "text": "noise " + json.dumps(good) + " noise", "deep": json.dumps([{"a": {"b": [good]}}]),
        "no_topics": json.dumps({**good, "topics": []}), "version": json.dumps({**good, "schema_version": "x"}), "junk": "hello",
    }
    for name, text in files.items():
        put(tmp_path / f"{name}.json", text)
    payloads = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("path"), "value")
    found = {r.path.removesuffix(".json"): r for r in J.unwrap_portfolios(payloads).collect()}
    assert sorted(found) == ["deep", "fenced", "inside", "plain", "text", "twice", "wrapped"]
    assert all(r.brand == "A & B" and r.queries[0].query == "best <EV>" and r.queries[1].query_id == "x" for r in found.values())


def test_side_files(spark, tmp_path):
    put(tmp_path / "out" / "md" / "1.md", "# Title\n\n" + "word " * 2000)
    put(tmp_path / "out" / "m" / "1.json", json.dumps({
        "metadata": {"canonical": "https://c/", "schema_types": ["Product"], "json_ld_present": True, "schema_block_count": 2, "language": "ja"},
        "links": [{"url": "https://l/", "text": "l"}] * 3, "extraction_metrics": {"heading_count": 9}, "geo_analysis_ready": True,
        "static_fetch": {"final_url": "https://f/"}}))
    rows = spark.createDataFrame([("https://a/", "md/1.md", "m/1.json"), ("https://b/", None, None)], "url string, markdown_file string, manifest_file string")
    root = str(tmp_path / "out")
    out = {r.url: r for r in P.with_side_files(rows, P.read_texts(spark, root), P.read_manifests(spark, root), extract_chars=6000).collect()}
    a, b = out["https://a/"], out["https://b/"]
    assert a.raw_markdown_chars == len("# Title\n\n" + "word " * 2000) and len(a.content_extract) <= 6003 and a.content_extract.endswith("...")
    assert (a.canonical_url, a.json_ld_block_count, a.final_url, a.language, a.schema_types) == ("https://c/", 2, "https://f/", "ja", ["Product"])
    assert a.content_metrics.heading_count == 9 and a.content_metrics.link_count == 3
    assert b.markdown == "" and b.final_url == "https://b/" and b.json_ld_present is False and b.content_metrics.heading_count == 0


def answers(spark):
    ref = lambda url, kind=None, title=None: (None, title, url, None, None, None, None, None, None, None, None, kind)
    rows = [
        ("r", 0, "q001", "best ev", [ref("https://x.com/1"), ref("https://pub.example/2", "publisher_review", "Pub")], "pending"),
        ("r", 1, "q002", "safety", [ref("https://pub.example/2", "publisher_review", "Later title")], None), ("r", 2, "q003", "none", [], None)]
    return spark.createDataFrame(rows, f"run_id string, pos int, query_id string, query string, references array<{C.RAW_REFERENCE}>, status string")


def test_refresh_scope_and_canonical_pages(spark):
    queries = spark.createDataFrame(
        [("r", 0, None, "best &amp; ev range", "EV", None), ("r", 1, "x2", "dealer nearby", None, None), ("r", 2, "x3", "too many", None, None)],
        "run_id string, pos int, query_id string, query string, topic string, recommended_page_type string")
    urls = spark.createDataFrame([("r", i, u) for i, u in enumerate(
        ["https://b.example/ev-range", "https://b.example/dealers", "https://b.example/company", "https://b.example/"], 1)], "run_id string, pos int, url string")
    s = refresh.scope(queries, urls, refresh.RefreshOptions(query_limit=2, pages_per_query=2, crawl_owned=False))
    assert sorted(r.query_id for r in s["queries"].collect()) == ["q001", "x2"]
    pages = {r.url: r for r in s["owned_pages"].collect()}
    top = pages["https://b.example/ev-range"]
    assert (top.rank, top.mapping_quality, top.brand_topic_category, top.crawl_status) == (1, "candidate", "EV", "not_requested")
    assert top.related_queries_seed == ["best & ev range"]
    counts = s["counts"].first()
    assert (counts.queries, counts.sitemap_urls) == (2, 4)

    owned = spark.createDataFrame([("r", 0, "https://b.example/ev-range", "word " * 40, "success", True), ("r", 1, "https://b.example/x", None, "failed", None)],
                                  "run_id string, pos int, url string, markdown string, crawl_status string, json_ld_present boolean")
    external = spark.createDataFrame([("r", 0, "https://pub.example/2", "some words", "success")], "run_id string, pos int, url string, markdown string, crawl_status string")
    scope_queries = answers(spark).select("run_id", "pos", "query_id", "query")
    c = refresh.canonicalise(owned, external, answers(spark), scope_queries)
    ext = c["external_pages"].first()
    assert ext.title == "Later title" and ext.source_type == "publisher_review"  # the later citation wins
    sources = {r.url: r for r in c["sources"].collect()}
    assert sources["https://pub.example/2"].citation_count == 2 and sources["https://pub.example/2"].title == "Pub"
    assert sources["https://pub.example/2"].crawl_status == "success" and sources["https://x.com/1"].source_type == "forum_social_video"
    assert {r.source_type: r.sources for r in c["source_type_counts"].collect()} == {"forum_social_video": 1, "publisher_review": 1}
    v = {r.query_id: r for r in c["visibility"].collect()}
    assert v["q001"].leading_citation_domain == "x.com" and v["q001"].winning_source_types == ["forum_social_video", "publisher_review"]
    assert v["q003"].citation_count == 0 and v["q003"].visibility_status == "serpapi_collected_no_citations"
    t = c["telemetry"].first()
    assert (t.owned_pages_attempted, t.owned_pages_crawled, t.owned_pages_failed, t.external_pages_crawled, t.external_citation_count) == (2, 1, 1, 1, 3)
    assert t.crawl_success_rate == 0.6667

    files = spark.createDataFrame([("r", "available", 0, "not_checked", 2)], "run_id string, robots_status string, robots_attempts int, llms_status string, llms_attempts int")
    h = refresh.site_hygiene(c["owned_pages"], files).first()
    assert (h.coverage_pct, h.priority, h.robots_status, h.llms_status) == (50.0, "medium", "available", "not found")

    bad = spark.createDataFrame([("r", i, f"https://f/{i}", None, "failed", None, "e" * 600) for i in range(120)],
                                "run_id string, pos int, url string, source_url string, crawl_status string, extraction_status string, error string")
    out = compact.compact(c, bad, files.select("run_id", "robots_status", "llms_status"))
    n = out["counts"].first()
    assert (n.owned_pages, n.owned_pages_scoreable, n.external_pages, n.external_pages_scoreable, n.external_failed_sources) == (2, 1, 1, 0, 100)
    assert len(out["failed_sources"].first().error) == 500 + len("\n...[truncated]")
    assert out["hygiene"].first().llms_status == "not checked"


def test_refresh_without_limits_keeps_all(spark):
    n = 70
    queries = spark.createDataFrame([("r", i * 100, None, f"topic{i:03} common", "T", None) for i in range(n)],
                                    "run_id string, pos int, query_id string, query string, topic string, recommended_page_type string")
    urls = spark.createDataFrame([("r", i, f"https://b.example/topic{i:03}") for i in range(n)] + [("r", n, "https://b.example/common")], "run_id string, pos int, url string")
    s = refresh.scope(queries, urls)
    counts = s["counts"].first()
    assert (counts.queries, counts.owned_pages, counts.sitemap_urls) == (n, n + 1, n + 1)
    assert sorted(r.query_rank for r in s["queries"].collect()) == list(range(1, n + 1))
    pages = {r.url: r for r in s["owned_pages"].collect()}
    assert sorted(r.rank for r in pages.values()) == list(range(1, n + 2))
    assert pages["https://b.example/common"].related_queries_seed == [f"topic{i:03} common" for i in range(n)]
    bad = spark.createDataFrame([("r", i, f"https://f/{i}", None, "failed", None, "e") for i in range(120)],
                                "run_id string, pos int, url string, source_url string, crawl_status string, extraction_status string, error string")
    assert sorted(r.rank for r in X.slim_failed(bad, n=None).collect()) == list(range(1, 121))


def test_collected_answers_win_over_placeholders(spark):
    placeholders = spark.createDataFrame([("r", 0, "q1", "pending"), ("r", 1, "q2", "pending")], "run_id string, pos int, query_id string, status string")
    collected = spark.createDataFrame([("r", 5, "q1", "done")], "run_id string, pos int, query_id string, status string")
    got = {r.query_id: r.status for r in refresh.prefer_collected(placeholders, collected).collect()}
    assert got == {"q1": "done", "q2": "pending"}


def test_reuse_by_id_or_text_or_all(spark):
    a = answers(spark).unionByName(answers(spark).withColumn("run_id", F.lit("other")))
    asked = spark.createDataFrame([("r", "q002", None), ("r", None, "  BEST   ev ")], "run_id string, query_id string, query string")
    got = sorted((r.run_id, r.query_id) for r in C.reusable_answers(a, asked).collect())
    assert got == [("other", "q001"), ("other", "q002"), ("other", "q003"), ("r", "q001"), ("r", "q002")]


def test_slim_pages_limits(spark):
    df = spark.createDataFrame([("r", 0, "https://a/", "x" * 70000, "success", [("u", "t")] * 100)],
                               "run_id string, pos int, url string, markdown string, crawl_status string, links array<struct<url:string,text:string>>")
    own = X.slim_pages(df, keys=("run_id", "pos")).first()
    ext = X.slim_pages(df, external=True, keys=("run_id", "pos")).first()
    marker = len("\n...[truncated]")
    assert len(own.markdown) == 60000 + marker and len(own.content_extract) == 12000 + marker and len(own.links) == 75
    assert len(ext.content_extract) == 8000 + marker and len(ext.links) == 25 and "markdown" not in ext.asDict()


@pytest.mark.parametrize("kind", ["json"])
def test_export_json(spark, tmp_path, kind):
    A.export_json(spark.createDataFrame([("r1", 1)], "run_id string, v int"), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).first().v == 1
