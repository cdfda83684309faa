"""Operators on the reference cases and on properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from citegrain.functions import markdown
from citegrain.functions.text import match_tokens
from citegrain.operators import citations as C
from citegrain.operators import classify, crawl, dedupe, hygiene as H, json_walks as J, mapping, merging, readiness as R
from citegrain.operators import portfolio as V, registry, status as S
from citegrain.operators.frames import first_n, first_wins
from citegrain.operators.ordinals import ordinals

PAGE = ("run_id string, pos int, url string, title string, json_ld_present boolean, json_ld_block_count int, "
        "schema_types array<string>, schema_types_detected array<string>, crawl_status string")


def hygiene_of(spark, pages, robots, llms):
    cover = H.structured_coverage(spark.createDataFrame(pages, PAGE), "run_id")
    return H.hygiene(cover, F.lit(robots), F.lit(llms)).first()


def test_hygiene_cases(spark):
    one = [("r", 0, "https://example.com/a", "A", False, 0, None, [], None)]
    h = hygiene_of(spark, one, "available", "not found")
    assert h.priority == "high" and "0/1 owned pages (0%)" in h.summary
    bare = [("r", 0, "https://example.com/a", "A", None, None, None, None, None)]
    h = hygiene_of(spark, bare, "available", "not found")
    assert h.priority == "high" and h.summary == H.NOT_FULLY_CHECKED_SUMMARY and h.coverage_pct == 0
    failed = [("r", 0, "https://example.com/a", None, None, None, None, [], "failed")]
    assert hygiene_of(spark, failed, "available", "available").summary == H.NOT_FULLY_CHECKED_SUMMARY
    crawled = [("r", 0, "https://example.com/a", None, None, None, None, [], "success")]
    assert hygiene_of(spark, crawled, "available", "available").structured_checked


def test_hygiene_counts_and_order(spark):
    pages = spark.createDataFrame([
        ("r", 0, "https://example.com/a", "A", False, 0, None, [], None),
        ("r", 1, "https://example.com/b", "B", True, 1, ["Product", "FAQPage"], None, None)], PAGE)
    c = H.structured_coverage(pages, "run_id").first()
    assert (c.pages_with_json_ld, c.pages_with_schema, c.coverage_pct) == (1, 1, 50.0)
    types = H.schema_type_counts(pages, "run_id").orderBy("rank").collect()
    assert [(t.schema_type, t.pages) for t in types] == [("Product", 1), ("FAQPage", 1)]
    missing = H.missing_json_ld(pages, "run_id", n=20).collect()
    assert [(m.url, m.title) for m in missing] == [("https://example.com/a", "A")]


@pytest.mark.parametrize("status,attempts,expected", [
    ("present", 0, "available"), ("FETCHED ", 0, "available"), ("404", 0, "not found"), ("not_requested", 0, "not checked"),
    ("not_checked", 2, "not found"), (None, 0, "not checked"), ("weird", 3, "not checked")])
def test_file_status(spark, status, attempts, expected):
    df = spark.createDataFrame([(status, attempts)], "s string, a int")
    assert df.select(H.file_status("s", F.col("a"))).first()[0] == expected


def test_full_inventory_is_scored(spark):
    text = ("## Charging support\nOfficial specifications, warranty conditions, safety guidance and 2026 update. "
            "Range 300 km. Charging 40 kW. ") * 12
    pages = [("r", i, f"https://www.acme.co.jp/direct-{i}.html", f"Direct page {i}", "success", 900, text,
              ["Charging support", "Specifications"], f"https://www.acme.co.jp/direct-{i}.html", i == 0, int(i == 0)) for i in range(4)]
    df = spark.createDataFrame(pages, "run_id string, pos int, url string, title string, crawl_status string, word_count bigint, markdown string, "
                               "headings array<string>, canonical_url string, json_ld_present boolean, json_ld_block_count int")
    from citegrain.plans import report

    empty = df.limit(0)
    workbench = spark.createDataFrame([("r", 0, "Q001", "direct", "https://www.acme.co.jp/direct-0.html")], "run_id string, pos int, query_id string, query string, url string")
    none = spark.createDataFrame([], "run_id string, url string")
    cites = spark.createDataFrame([], "run_id string, query_id string, url string, citation_position int, source_rank int, pos int")
    out = report.enrich(empty, [df], workbench, none, cites)
    rows = {r.url: r for r in out["readiness"].collect()}
    assert len(rows) == 4
    first, last = rows["https://www.acme.co.jp/direct-0.html"], rows["https://www.acme.co.jp/direct-3.html"]
    assert first.query_mapped and not last.query_mapped
    assert last.current_geo_score_120 > 0 and last.geo_dimensions["semantic_depth"] > 0
    assert {r.scoring_method for r in rows.values()} == {"crawl_evidence_v1"}
    assert first.inventory_source == "query_mapped" and last.inventory_source == "sitemap_inventory"
    assert all(sum(r.geo_dimensions.values()) == r.current_geo_score_120 for r in rows.values())
    assert all(0 <= v <= 20 for r in rows.values() for v in r.geo_dimensions.values())
    roll = out["rollup"].first()
    assert (roll.owned_pages_scoreable, roll.owned_query_mapped_unique) == (4, 1)
    m = report.manifests(spark.createDataFrame([("r",), ("empty",)], "run_id string"), out, workbench, F.lit(5))
    got = {r.run_id: (r.status, r.query_count) for r in m.collect()}
    assert got == {"r": ("completed", 1), "empty": ("completed_invalid_report", 0)}


def test_report_layers_fill_fields(spark):
    schema = "run_id string, pos int, url string, title string, current_geo_score_120 double, geo_dimensions map<string,double>"
    report_rows = spark.createDataFrame([("r", 0, "https://a/1/", "", 10.0, {"content_clarity": 4.0})], schema)
    artifact = spark.createDataFrame([("r", 0, "https://a/1", "Crawled", 30.0, {"content_clarity": 9.0}), ("r", 1, "https://a/2", "Two", 5.0, None)], schema)
    merged = merging.merge_report_rows(R.canonical_rows(report_rows), R.canonical_rows(artifact))
    rows = {r.url_key: r for r in merged.collect()}
    assert rows["https://a/1"].title == "Crawled" and rows["https://a/1"].current_geo_score_120 == 10.0
    assert rows["https://a/1"].geo_dimensions == {"content_clarity": 4} and rows["https://a/2"].current_geo_score_120 == 5.0


def test_zero_counts_are_values_but_zero_scores_are_not(spark):
    schema = "run_id string, pos int, url_key string, current_geo_score_120 double, json_ld_block_count int, query_mapped boolean"
    first = spark.createDataFrame([("r", 0, "u", 0.0, 0, False)], schema)
    second = spark.createDataFrame([("r", 0, "u", 7.0, 3, True)], schema)
    row = merging.merge_report_rows(first, second).first()
    assert (row.current_geo_score_120, row.json_ld_block_count, row.query_mapped) == (7.0, 0, True)


def brute_force(queries, urls, k, tokens):
    out = {}
    for run, qpos, text in queries:
        ranked = []
        for r, upos, url in urls:
            if r != run:
                continue
            score = len(tokens[text] & tokens[url])
            for term, words in mapping.BOOST_RULES:
                if term in text.lower() and any(w in url.lower() for w in words):
                    score += 3
            ranked.append((-score, len(url), upos, url))
        ranked.sort()
        best = [x for x in ranked[:k] if x[0] < 0] or ranked[:k]
        for i, (s, _, _, url) in enumerate(best, 1):
            out[(run, qpos, i)] = (url, -s)
    return out


@pytest.mark.parametrize("frequent", [0, 3, None])
def test_mapping_equals_brute_force(spark, frequent):
    rng = random.Random(7)
    words = ["price", "safety", "ev", "service", "range", "battery", "city", "leaf", "model", "kei", "zz", "charging"]
    urls = [(run, i, f"https://www.h{i % 5}.example/{'-'.join(rng.sample(words, rng.randint(1, 4)))}/{'x' * rng.randint(0, 3)}{i}")
            for run in ("a", "b") for i in range(40)]
    queries = [(run, i, " ".join(rng.sample(words + ["https", "example", "www"], rng.randint(1, 4)))) for run in ("a", "b") for i in range(25)]
    queries += [("a", 100, "qq rr"), ("b", 101, "")]
    q = spark.createDataFrame([(r, p, f"q{p}", t) for r, p, t in queries], "run_id string, pos int, query_id string, query string")
    u = spark.createDataFrame(urls, "run_id string, pos int, url string")
    texts = [(t,) for _, _, t in queries] + [(x[2],) for x in urls]
    cleaned = spark.createDataFrame(texts, "t string").select("t", match_tokens(F.translate("t", "-_/", "   ")).alias("k")).collect()
    tokens = {r.t: set(r.k) for r in cleaned}
    got = {(r.run_id, r.qpos, r["rank"]): (r.url, r.mapping_score) for r in mapping.map_queries(q, u, 3, frequent=frequent).collect()}
    assert got == brute_force(queries, urls, 3, tokens)


def test_mapping_forms_pairs_in_proportion_to_the_site(spark):
    """Sections of a growing site have words of their own; the words that all sections share form no pairs."""
    rng, pairs, matches = random.Random(9), [], []
    for n in (200, 400, 800):
        words = lambda section, m: [f"w{section}x{rng.randrange(12)}" for _ in range(m)] + rng.sample(["the", "price", "service", "guide", "dealer"], 3)
        urls = [("a", i, f"https://example.org/{'-'.join(words(i // 20, 3))}/{i}") for i in range(n)]
        queries = [("a", i, f"q{i}", " ".join(words(rng.randrange(n // 20), 2))) for i in range(n // 2)]
        u = spark.createDataFrame(urls, "run_id string, pos int, url string")
        asked = mapping.query_tokens(spark.createDataFrame(queries, "run_id string, pos int, query_id string, query string"))
        sets = asked.groupBy("run_id", F.col("qpos").alias("qset")).agg(F.collect_set("token").alias("tokens"))
        q_tokens, u_tokens, _ = mapping._told_apart(sets, u, "run_id", None)
        keyed = u.select("run_id", F.col("pos").alias("upos"), "url", F.length("url").alias("ulen"))
        pairs.append(mapping.candidate_pairs(q_tokens, u_tokens, keyed, 3, "run_id").count())
        matches.append(q_tokens.join(u_tokens, "token").select("qset", "upos").distinct().count())
    assert all(b < 2.4 * a for a, b in zip(pairs, pairs[1:]))  # in proportion
    assert all(b > 3.4 * a for a, b in zip(matches, matches[1:]))  # pairs that share a word grow with the square
    assert pairs[-1] * 10 < matches[-1]


def test_mapping_returns_k_pairs_per_set_and_shard(spark, monkeypatch):
    """Words that recur at fixed rates on every part of a site; several shards and blocks give the same mapping."""
    rng, words = random.Random(3), [f"word{i}" for i in range(60)]
    urls = [("a", i, f"https://example.org/{'-'.join(rng.sample(words, 8))}/{i}") for i in range(600)]
    queries = [("a", i, " ".join(rng.sample(words + ["dealer", "nothing"], 5))) for i in range(60)]
    u = spark.createDataFrame(urls, "run_id string, pos int, url string")
    q = spark.createDataFrame([(r, p, f"q{p}", t) for r, p, t in queries], "run_id string, pos int, query_id string, query string")
    sets = mapping.query_tokens(q).groupBy("run_id", F.col("qpos").alias("qset")).agg(F.collect_set("token").alias("tokens"))
    q_tokens, u_tokens, _ = mapping._told_apart(sets, u, "run_id", None)
    keyed = u.select("run_id", F.col("pos").alias("upos"), "url", F.length("url").alias("ulen"))
    assert mapping.candidate_pairs(q_tokens, u_tokens, keyed, 3, "run_id").count() <= 3 * len(queries)
    tokens = {t: {x for x in t.translate(str.maketrans("-_/.:", "     ")).split() if len(x) >= 3} for t in [x[2] for x in queries + urls]}
    want = brute_force(queries, urls, 3, tokens)
    for name, value in {"URLS_PER_SHARD": 150, "LEAST_SETS": 7, "RARE_SHARE": 8}.items():
        monkeypatch.setattr(mapping, name, value)
    assert {(r.run_id, r.qpos, r["rank"]): (r.url, r.mapping_score) for r in mapping.map_queries(q, u, 3).collect()} == want


def test_mapping_counts_a_word_of_a_repeated_url_once(spark):
    rows = [("a", 1, "https://example.org/alpha-other/1")] * 2 + [("a", 2, "https://example.org/alpha-beta/22")] + [("a", i, f"https://example.org/x{i}") for i in range(3, 300)]
    u = spark.createDataFrame(rows, "run_id string, pos int, url string")
    q = spark.createDataFrame([("a", 0, "q0", "alpha beta")], "run_id string, pos int, query_id string, query string")
    got = [(r["rank"], r.upos, r.mapping_score) for r in mapping.map_queries(q, u, 3).orderBy("rank").collect()]
    assert got == [(1, 2, 2), (2, 1, 1), (3, 1, 1)]


def test_sentence_questions_equal_their_pattern(spark):
    rng = random.Random(5)
    bits = ["?", "？", "。", ".", "\n", "!", " ", "word", "a b c d ", "x" * 40, "y" * 130, "年次報告", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markdown._sentence_questions("t").alias("q")).collect()
    assert all(r.q == re.findall(markdown.QUESTION_PATTERNS[2], r.t) for r in rows) and sum(len(r.q) for r in rows) > 300


def test_readiness_lowers_its_text_once(spark):
    pages = spark.createDataFrame([("A text of 2024 is this?",)], "markdown string")
    assert len(re.findall(r"lower\((?!coalesce)", str(R.readiness(pages)._jc))) == 1  # that of the status is short


def test_first_n_beyond_the_map_side_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("pos"))
    rows = first_n(df, "k", ["pos"], 1500).groupBy("k").agg(F.count("*").alias("n"), F.max("pos").alias("m"), F.max("rank").alias("r")).collect()
    assert sorted((r.k, r.n, r.m, r.r) for r in rows) == [(0, 1500, 2998, 1500), (1, 1500, 2999, 1500)]


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([(1, i % 3, 10 - i) for i in range(9)], "run int, k int, pos int")
    once = first_wins(df, ["run", "k"], "pos")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, first_wins(once, ["run", "k"], "pos").collect()))
    assert {r.k: r.pos for r in once.collect()} == {0: 4, 1: 3, 2: 2}


def test_ordinals_cross_blocks(spark):
    df = spark.createDataFrame([("a", p) for p in (5, 1, 9000, 4096, 20000)] + [("b", 7)], "k string, pos int")
    got = {(r.k, r.pos): r.n for r in ordinals(df, "k", "pos", "n").collect()}
    assert got == {("a", 1): 1, ("a", 5): 2, ("a", 4096): 3, ("a", 9000): 4, ("a", 20000): 5, ("b", 7): 1}


def test_merge_pages_adds_each_crawled_page_once(spark):
    existing = spark.createDataFrame([("r", 0, "https://a/1", "old"), ("r", 1, "https://a/9", "keep"), ("r", 2, None, "nameless")], "run_id string, pos int, url string, title string")
    crawled = spark.createDataFrame([
        ("r", 0, "https://a/1x", "https://a/1", None, "new"), ("r", 1, "https://a/2", "https://a/2b", "https://a/2c", None)],
        "run_id string, pos int, url string, source_url string, final_url string, title string")
    rows = sorted(merging.merge_pages(existing, crawled).collect(), key=lambda r: tuple(r.merge_pos))
    assert [(r.url, r.title) for r in rows] == [("https://a/1x", "new"), ("https://a/9", "keep"), (None, "nameless"), ("https://a/2", None)]


def test_crawl_enrichment_cases(spark):
    schema = "url string, source_url string, markdown string, crawl_status string, extraction_status string, word_count bigint, domain string"
    df = spark.createDataFrame([
        ("https://www.a.com/1", None, "word " * 30, None, "pending", None, None),
        (None, "https://b.com/2", None, "success", None, None, None),
        ("https://c.com/3", None, "few words", "success", "", 0, "given"),
        ("https://d.com/4", None, None, "not_requested", "not_requested", None, None)], schema)
    rows = {r.url: r for r in crawl.enrich_pages(df).collect()}
    a, b, c, d = (rows[u] for u in ("https://www.a.com/1", "https://b.com/2", "https://c.com/3", "https://d.com/4"))
    assert (a.crawl_status, a.extraction_status, a.geo_analysis_ready, a.content_score_policy, a.word_count, a.domain) == ("success", "success", True, "score", 30, "a.com")
    assert (b.crawl_status, b.geo_analysis_ready, b.content_score_policy) == ("partial_success_empty_text", False, "metadata_only_until_crawled")
    assert (c.word_count, c.geo_analysis_ready, c.extraction_status, c.domain) == (2, False, "success", "given")
    assert (d.crawl_status, d.extraction_status, d.geo_analysis_ready) == ("not_requested", "not_requested", False)
    ext = crawl.enrich_pages(df.withColumn("hint_title", F.lit("T")), external=True, hint_prefix="hint_").where("url = 'https://www.a.com/1'").first()
    assert ext.content_score_policy == "benchmark_score" and ext.title == "T"


def test_telemetry_without_attempts_has_no_rate(spark):
    df = spark.createDataFrame([("r", "owned", "pending", None, None)], "run_id string, kind string, crawl_status string, geo_analysis_ready boolean, word_count bigint")
    assert crawl.run_telemetry(df).first().crawl_success_rate is None


STATUS = "run_id string, status string, stage string, auditor_error string, error string, failed boolean, updated_at_epoch bigint"


@pytest.mark.parametrize("status,stage,auditor_error,error,failed,age,expected", [
    ("running", "crawl", None, None, None, 10, True), ("completed", "x", None, None, None, 10, False), ("cancelled", "x", None, None, None, 10, False),
    ("running", "report_bundle_ready", None, None, None, 10, False), ("running", "crawl", "boom", None, None, 10, False),
    ("running", "crawl", None, "boom", None, 10, False), ("running", "auditor_failed", None, None, None, 10, False),
    ("running", "crawl", None, None, True, 10, False), ("running", "crawl", None, None, None, 3600, True),
    ("running", "crawl", None, None, None, 3601, False), ("running", "auditor_running", None, None, None, 3601, True),
    ("running", "auditor_running", None, None, None, 7201, False), ("x", "evidence_ready", None, None, None, 7200, True),
    ("x", "evidence_ready", None, None, None, 7201, False), ("RUNNING", "Crawl", "", "", False, 10, True), ("unknown", "crawl", None, None, None, 10, False),
    ("queued", "crawl", None, None, None, None, True)])
def test_active_truth_table(spark, status, stage, auditor_error, error, failed, age, expected):
    now = 1_700_000_000
    df = spark.createDataFrame([("r", status, stage, auditor_error, error, failed, now - age if age is not None else None)], STATUS)
    assert df.select(S.is_active(df.columns, F.lit(now))).first()[0] is expected


def test_latest_run_falls_back_to_a_scan(spark):
    """Each request gets the run that the single-request functions find for it."""
    ready = ("completed", "report_bundle_ready", True)
    values = [("Acme", "UK", "https://a.example"), ("Acme", "UK", None), ("Acme", "Peru", "b.example"), ("", "Peru", None), ("Solo", "", "a.example"), (None, None, None)]
    rows = [(f"r{i}", b, m, d, *ready, 100 - 7 * i, i != 1) for i, (b, m, d) in enumerate(values)]
    runs = spark.createDataFrame(rows, "run_id string, brand string, market string, domain string, status string, stage string, dashboard_ready boolean, completed_at_epoch bigint, has_payload boolean")
    asked = [(b, m, d) for b in ("Acme", "Solo", "", "ALL", None, "nobody") for m in ("UK", "Peru", "", "all", None) for d in ("a.example", "b.example", "all", "", None)]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "request_id int, brand string, market string, domain string")
    got = {r.request_id: (r.run_id, r.matched_by) for r in registry.resolve_latest(requests, runs).collect()}
    key = lambda v: (v or "").lower().replace("https://", "")
    usable = [(key(b), key(m), key(d), e, r) for r, b, m, d, _, _, _, e, ok in rows if ok]
    for i, (b, m, d) in enumerate(asked):
        b, m, d = key(b), key(m), key(d)
        pick = lambda test: max(((e, r) for x, y, z, e, r in usable if test(x, y, z)), default=(0, None))[1]
        named = lambda x, y: x == b and y == m and x and y
        hand = [(pick(lambda x, y, z: named(x, y) and d and z == d), "domain"), (pick(lambda x, y, z: named(x, y)), "market"),
                (pick(lambda x, y, z: (b in ("", "all") or x == b) and (m in ("", "all") or y == m) and (d in ("", "all") or z in ("", d))), "scan")]
        assert got.get(i) == next((h for h in hand if h[0]), None), asked[i]
    assert {how for _, how in got.values()} == {"domain", "market", "scan"}


def test_running_newer_run_does_not_replace_completed(spark):
    m = spark.createDataFrame([
        ("old", "Acme", "Japan", None, "report_bundle_ready", "completed", True, 100, 100),
        ("new", "Acme", "Japan", None, "evidence_ready", "running", False, 9999999999, None)],
        "run_id string, brand string, market string, domain string, stage string, status string, dashboard_ready boolean, created_at_epoch bigint, completed_at_epoch bigint")
    assert [r.run_id for r in registry.latest_successful(m).collect()] == ["old"]
    assert registry.scan_latest(m, "acme", "JAPAN", "https://any.example").first().run_id == "old"
    none = spark.createDataFrame([], "run_id string, stage string")
    assert registry.history(m, none, "", "all", limit=0).count() == 1
    statuses = spark.createDataFrame([("old", "done", 7, True)], "run_id string, stage string, serpapi_rows bigint, crawl_owned boolean")
    row = registry.history(m, statuses).first()
    assert (row.stage, row.status, row.serpapi_query_count, row.crawl_owned, row.crawl_external) == ("done", "completed", 7, True, False)
    assert row.label == "Acme / Japan — old"


def test_config_upsert_and_order(spark):
    rows = [("c1", "Zebra", "US", "English", 1), ("c2", "apple", "US", "English", 2), ("c9", "Zebra", "us", "German", 3), ("c3", "BMW", "DE", "German", 4)]
    h = spark.createDataFrame(rows, "config_id string, brand string, market string, language string, updated_at int")
    listed = registry.list_configs(registry.current_configs(h, ("language",))).collect()
    assert [r.brand for r in listed] == ["apple", "BMW", "Zebra"]
    assert (listed[2].config_id, listed[2].language, listed[2].created_at) == ("c1", "German", 1)


def test_portfolio_rules(spark):
    q = spark.createDataFrame([
        ("p1", 0, "test 1", "q001", None, None), ("p1", 1, "test 2", "q001", None, None),
        ("p2", 0, "test", None, "invalid_stage", None), ("p3", 0, None, "q001", None, None)],
        "portfolio_id string, pos int, query string, query_id string, journey_stage string, query_type string")
    p = spark.createDataFrame([(x, V.SCHEMA_VERSION, "b", "m") for x in ("p1", "p2", "p3", "p4")], "portfolio_id string, schema_version string, brand string, market string")
    t = spark.createDataFrame([(x, 0, "EV", None) for x in ("p1", "p2", "p3")], "portfolio_id string, pos int, topic string, name string")
    v = {r.portfolio_id: r for r in V.portfolio_verdicts(p, t, q).collect()}
    assert v["p1"].valid and v["p1"].warnings == 1
    assert not v["p2"].valid and not v["p3"].valid
    assert not v["p4"].valid and v["p4"].errors == 2
    messages = [r.message for r in V.query_messages(q).collect()]
    assert any("duplicate query_id 'q001'" in m for m in messages) and any("journey_stage 'invalid_stage'" in m for m in messages)
    ids = V.normalise_queries(q.withColumn("query_id", F.when(F.col("pos") == 1, "custom_1"))).where("portfolio_id = 'p1'").orderBy("pos").collect()
    assert [r.query_id for r in ids] == ["q001", "custom_1"]


def test_source_classes(spark):
    d = classify.SourceDomains(owned=("brand.jp",), ecosystem=("dealers.example",), off_market=("brand.us",))
    df = spark.createDataFrame([
        ("https://www.brand.jp/x", ""), ("https://a.dealers.example/", ""), ("https://brand.us/", ""), ("https://x.go.jp/", ""), ("https://n.com/", "Reuters"),
        ("https://www.reddit.com/r", ""), ("https://youtu.be/1", ""), ("https://plain.example/", "")], "url string, name string")
    rows = df.select(classify.source_class("url", "name", None, d).alias("c")).collect()
    assert [(r.c.source_type, r.c.source_quality) for r in rows] == [
        ("owned_brand", "high"), ("owned_ecosystem", "high"), ("off_market_owned", "medium"), ("authority_body", "high"),
        ("news_media", "medium"), ("forum_community", "low"), ("video_social", "low"), ("other", "low")]


def test_json_walks(spark):
    raw = spark.createDataFrame([
        ("r", "q1", "Q", '{"x":{"citations":["https://a/1",{"url":"https://a/1"},{"link":"ftp://x"},{"source_url":"https://a/2","source":"S","text":"t"}]},'
                         '"organic_results":[' + ",".join('{"link":"https://o/%d"}' % i for i in range(20)) + '],"answer_box":["one","two"]}'),
        ("r", "q2", "Q", "not json"), ("r", "q3", "Q", None), ("r", "q4", "Q", '{"deep":{"snippet":"short","more":{"text":"' + "long " * 20 + '"}}}')],
        "run_id string, query_id string, query string, raw string")
    out = {r.query_id: r for r in J.raw_answers(raw, max_references=10).collect()}
    assert set(out) == {"q1", "q4"}
    assert len(out["q1"].references) == 10 and [r.url for r in out["q1"].references[:3]] == ["https://a/1", "https://a/2", "https://o/0"]
    assert out["q1"].answer_summary == "one two" and out["q4"].answer_summary.startswith("long long")
    n = {r.query_id: r for r in C.normalise_answers(J.raw_answers(raw, max_references=10)).collect()}
    assert n["q1"].status == C.WITH_CITATIONS and n["q4"].status == C.NO_CITATIONS and len(n["q1"].top_citations) == 3


def test_collect_urls_order_and_split(spark):
    doc = '{"url":"https://a.com/1#x","items":[{"Page_URL":"https://b.com/2"},{"url":{"url":"https://c.com/3"}},"https://ignored/"],"url2":"https://no/"}'
    rows = J.collect_urls(spark.createDataFrame([("r", doc), ("s", "[]"), ("t", "oops")], "run_id string, doc string")).orderBy("pos").collect()
    assert [r.url for r in rows] == ["https://a.com/1", "https://b.com/2", "https://c.com/3"]


def test_inventory_split_uses_suffix_not_substring(spark):
    urls = spark.createDataFrame([("r", 0, "https://notexample.com/"), ("r", 1, "https://a.example.com/x#1"), ("r", 2, "https://a.example.com/x"), ("s", 0, "https://example.com/")], "run_id string, pos int, url string")
    domains = dedupe.owned_domains(spark.createDataFrame([("r", "https://www.example.com")], "run_id string, domain string"))
    got = {(r.run_id, r.url): r.is_owned for r in dedupe.inventory([urls], domains, 5, 5).collect()}
    assert got == {("r", "https://notexample.com/"): False, ("r", "https://a.example.com/x"): True, ("s", "https://example.com/"): False}


def test_template_gate_and_defaults(spark):
    t = V.template(spark, "Acme").withColumn("portfolio_id", F.lit("t1"))
    assert t.where(V.is_valid_portfolio()).count() == 1
    topics, queries = V.explode_portfolios(t)
    v = V.portfolio_verdicts(t, topics, queries).first()
    assert v.valid and v.warnings == 0 and (v.topic_count, v.query_count) == (2, 3)
    bad = t.withColumn("schema_version", F.lit("x.v1")).unionByName(t.withColumn("topics", F.slice("topics", 1, 0)))
    assert bad.where(V.is_valid_portfolio()).count() == 0
    p = spark.createDataFrame([(None, "b", " ", "rb", "rm")], "schema_version string, brand string, market string, request_brand string, request_market string")
    d = V.with_defaults(p).first()
    assert (d.schema_version, d.brand, d.market, d.portfolio_source) == (V.SCHEMA_VERSION, "b", "rm", "user_upload")


def test_stored_portfolios_get_ids_and_two_keys(spark):
    schema = "portfolio_id string, schema_version string, brand string, market string, domain string, created_at_epoch bigint"
    old = spark.createDataFrame([("p_old", V.SCHEMA_VERSION, "A b", "M", "https://d", 5)], schema)
    new = spark.createDataFrame([(None, None, "A b", "M", "https://d", None), ("given", "", "A b", "M", None, None)], schema)
    stored = registry.store_portfolios(old, new, F.lit(9).cast("bigint"))
    rows = stored.where("created_at_epoch = 9").collect()
    assert {r.schema_version for r in rows} == {V.SCHEMA_VERSION} and any(r.portfolio_id.startswith("portfolio_a_b_m_9_") for r in rows)
    latest = {r.latest_key: r.portfolio_id for r in registry.latest_portfolios(stored).collect()}
    assert set(latest) == {"a_b__m", "a_b__m__d"} and latest["a_b__m__d"].startswith("portfolio_a_b_m_9_")


def test_hot_key_is_split(spark):
    """A third of all rows on one key: the plan ranks and reduces before the shuffle."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("pos"))
    ranked = first_n(df, "k", ["pos"], 5)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial before the exchange, final after
    assert ranked.where("k = 0").count() == 5
    reduced = first_wins(df, "k", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in reduced


def test_json_walks_survive_deep_and_long_documents(spark):
    deep = "[" * 100_000 + "]" * 100_000
    many = '{"references": [' + ",".join(f'{{"url": "https://a.example/{i}", "snippet": "{"s" * 600} &amp; t"}}' for i in range(25)) + "]}"
    rows = [("d", "q1", "x", deep), ("m", "q2", "x", many), ("n", "q3", "x", None)]
    df = spark.createDataFrame(rows, "run_id string, query_id string, query string, raw string")
    answers = {r.run_id: r for r in J.raw_answers(df).collect()}
    assert answers["d"].walk_error and answers["m"].walk_error is None
    assert len(answers["m"].references) == 25 and len(answers["m"].references[0].snippet) == 605 + 3
    urls = J.collect_urls(df, "raw", ("run_id",)).collect()
    assert sum(r.run_id == "m" for r in urls) == 25 and [r.walk_error is not None for r in urls if r.run_id == "d"] == [True]
    nested = spark.createDataFrame([("p", '{"a":' * 300 + '{"access_token": "s", "b": ["x"]}' + "}" * 300)], "k string, doc string")
    assert "[REDACTED]" in J.redact_json(nested, "doc", ("k",)).first().doc.upper() or "redacted" in J.redact_json(nested, "doc", ("k",)).first().doc.lower()


def test_runs_without_pages_have_hygiene(spark):
    from citegrain.plans.refresh import site_hygiene

    pages = spark.createDataFrame([("a", "https://x.example/", True)], "run_id string, url string, json_ld_present boolean")
    files = spark.createDataFrame(
        [("a", "available", 1, "available", 1, 7), ("b", "404", 2, "available", 1, 0)],
        "run_id string, robots_status string, robots_attempts int, llms_status string, llms_attempts int, sitemap_entries_count int")
    rows = {r.run_id: r for r in site_hygiene(pages, files).collect()}
    assert rows["a"].coverage_pct == 100.0 and rows["a"].sitemap_entries_count == 7
    assert (rows["b"].owned_pages_total, rows["b"].coverage_pct, rows["b"].priority) == (0, 0.0, "high") and rows["b"].summary == H.NOT_FULLY_CHECKED_SUMMARY
