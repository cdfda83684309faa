"""Column functions on edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from citegrain.functions import markdown as M
from citegrain.functions import text as T
from citegrain.functions import url as U

URLS = [
    "https://WWW.Example.co.jp:443/a/b.PDF?x=1#f", "example.com/x", None, "", "http://?a", "http://h/", "HTTP://h/x/",
    "  https://user@a.b.c:8080/x;p=1//  ", "//cdn.example.com/lib", "http://notexample.com/", "mailto:a@b.c", "http://a b/c",
]


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_url_functions(spark):
    assert values(spark, U.valid_url("v"), URLS) == [
        "https://WWW.Example.co.jp:443/a/b.PDF?x=1", None, None, None, None, "http://h/", None,
        "https://user@a.b.c:8080/x;p=1//", None, "http://notexample.com/", None, "http://a b/c",
    ]
    assert values(spark, U.url_key("v"), URLS)[:6] == [
        "https://www.example.co.jp:443/a/b.pdf?x=1", "example.com/x", "", "", "http://?a", "http://h"]
    assert values(spark, U.host("v"), URLS)[:2] == ["example.co.jp:443", ""]
    assert values(spark, U.host_without_default_port("v"), URLS)[0] == "www.example.co.jp"
    assert values(spark, U.host_without_default_port("v"), URLS)[7] == "user@a.b.c:8080"
    assert values(spark, U.is_valid_url("v"), URLS)[6] is True
    assert values(spark, U.is_pdf_url("v"), URLS)[0] is True
    assert values(spark, U.normalize_url("v"), URLS)[0] == "https://www.example.co.jp:443/a/b.PDF?x=1"
    assert values(spark, U.normalize_url("v"), URLS)[7] == "https://user@a.b.c:8080/x;p=1"
    assert values(spark, U.normalize_url("v", True), URLS)[5] == "http://h/"


@pytest.mark.parametrize("host,site", [
    ("example.com", "example.com"), ("a.b.example.com", "example.com"), ("shop.example.co.jp", "example.co.jp"),
    ("x.go.jp", "x.go.jp"), (".a.b.", "a.b"), ("localhost", "localhost")])
def test_site_domain(spark, host, site):
    assert values(spark, U.site_domain("v"), [host]) == [site]


def test_domains(spark):
    hosts = ["example.com", "a.example.com", "notexample.com", "www.acmeusa.com", ""]
    assert values(spark, U.matches_any_domain("v", ["Example.com", "acmeusa.com"]), hosts) == [True, True, False, True, False]
    assert values(spark, U.owned_domain_forms("v"), ["https://www.acme.com", "acmeusa.com", " "]) == [
        ["www.acme.com", "acme.com"], ["acmeusa.com", "www.acmeusa.com"], []]
    assert values(spark, U.host_suffixes("v"), ["a.b.c"]) == [["a.b.c", "b.c", "c"]]
    assert values(spark, U.base_variants("v"), ["https://www.a.com/x", "http://b.com", "b.com"]) == [
        ["https://www.a.com", "https://www3.a.com", "https://www2.a.com"], ["http://b.com"], []]


def test_keys_and_markets(spark):
    assert values(spark, U.registry_key("v"), [" https://www.A.com:8080/b c ", None]) == ["www.a.com_8080_b_c", ""]
    assert values(spark, U.market_region("v"), [" Japan ", "UK", "us", "xx", "Narnia", None, "global"]) == [
        "jp", "uk", "us", "xx", "us", "us", "us"]


def test_percent_and_redaction(spark):
    assert values(spark, T.percent_text("v"), [0.0, 50.0, 33.3, None], "double") == ["0", "50", "33.3", "0"]
    secrets = {"API_KEY": "x", "my_token": "y", "access_token_old": "z", "tokens": "kept", "user": "u"}
    out = values(spark, T.redact_map("v"), [secrets], "map<string,string>")[0]
    assert out == {"API_KEY": "[REDACTED]", "my_token": "[REDACTED]", "access_token_old": "[REDACTED]", "tokens": "kept", "user": "u"}


def test_rounding_is_half_even(spark):
    # 15 of 16 lines equal: 1 - 2/16 = 0.875; 1/16 in percent = 6.25 -> 6.2
    assert spark.range(1).select(F.bround(F.lit(6.25), 1)).first()[0] == 6.2
    lines = "\n".join(["the same long line of text here"] * 7 + ["another long line of text here!"])
    assert values(spark, M.duplicate_block_ratio("v"), [lines, "short", None]) == [0.75, 0.0, 0.0]


RICH = (
    "# What is the real range of it?\n\n- How long does charging take at home?\nIs it safe?\nSee https://a.com/x.pdf?y\n"
    "充電時間はどれくらいかかりますか？\nOne. Two! Does the warranty cover the battery pack? Yes\n| a | b | c |\r\n| 1 | 2 | 3 |\x0b| x | y | z |\n"
)


def test_questions(spark):
    found = values(spark, M.real_questions("v"), [RICH])[0]
    assert found[0] == "What is the real range of it?"
    assert found[1] == "How long does charging take at home?"
    assert "充電時間はどれくらいかかりますか？" in found
    assert "Does the warranty cover the battery pack?" in found
    assert not any("safe" in q for q in found)  # three words only
    assert len(values(spark, M.real_questions("v", 2), [RICH])[0]) == 2


def test_question_count_equals_plain_pattern(spark):
    pattern = re.compile(r"[^\n。.!?]{6,140}[?？]")
    texts = [RICH, "a" * 300 + "?" + "b" * 5 + "?", "", "x？y？zzzzzzzzz？ w. more words here?\n?", "no question here." * 50]
    assert values(spark, M.question_count("v"), texts) == [len(pattern.findall(t)) for t in texts]


def test_numbers_and_dates(spark):
    text = "Range 300 km or 300 km, ¥ 5,000 x12km 40kW 12 260km 20%off 25% 2024/05/06 Updated: May 3\n更新日：2024年5月6日 令和6年 5月 6日"
    numbers = values(spark, M.numeric_mentions("v"), [text])[0]
    expected = re.findall(
        r"(?<![A-Za-z0-9_])(?:¥\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:%|km|kWh|kW|円|yen|万円|年|ヶ月|か月|人|名|seats?|L|litres?|リットル|mm|m|hours?|minutes?|分|歳))(?![A-Za-z0-9_])", text, re.I)
    keep = [x.strip() for x in expected if not re.search(r"20[0-9]{2}/|260[0-9]|251[0-9]|2540|1778|adobe|utm", x.lower())]
    assert numbers == list(dict.fromkeys(keep))
    dates = values(spark, M.visible_dates("v"), [text])[0]
    assert dates[0] == "2024/05/06" and "令和6年 5月 6日" in dates and any(d.startswith("更新日") for d in dates)


def test_line_dedupe(spark):
    text = "# Menu\nMenu\nCall 123 now\n\n\nCall 456 now\n# Menu\nx\n5\nhttps://a.com only\nonly\r\nEnd"
    assert values(spark, M.dedupe_lines("v"), [text]) == ["# Menu\nMenu\nCall 123 now\n\nhttps://a.com only\nEnd"]


def test_clean_for_scoring(spark):
    text = (
        "![i](http://a/i.png) Good [page](https://a.com/p) text here\nAccept all cookies\nA - B - C - D - E\n| a | b | c | d |\n"
        "https://only.url/\nutm_source=x value\nab\nFine. A - B - C - D - E\\nsecond"
    )
    assert values(spark, M.clean_for_scoring("v"), [text])[0].split("\n") == [
        "Good page text here", "value", "Fine. A - B - C - D - E", "second"]


def test_metrics(spark):
    m = values(spark, M.markdown_metrics("v"), ["## A\n- b [x](https://a.com/d.PDF) ![alt](https://a.com/i.png) ![](https://a.com/j.png)\n1,234 km 5.5% x9 九9\n" + RICH])[0]
    assert (m.heading_count, m.bullet_count, m.link_count, m.image_count, m.pdf_link_count, m.image_alt_count) == (2, 2, 2, 2, 1, 1)
    assert m.table_like and m.table_line_count == 3
    assert m.numeric_facts_sample[:2] == ["1,234", "5.5%"]


def test_white_space_and_entities(spark):
    assert values(spark, T.compact("v"), ["　 a \n b ", None]) == ["a b", ""]
    assert values(spark, T.compact_block("v"), ["a  \t b\n   c\n\n\n\nd  "]) == ["a b\nc\n\nd"]
    assert values(spark, T.clean_value("v", 5), ["&lt;a&gt; &amp;amp; long", None]) == ["<a> &", ""]
    assert values(spark, T.truncate("v", 4), ["abc  def", "abcd", None]) == ["abc\n...[truncated]", "abcd", None]
    assert values(spark, T.compact_limited("v", 5), ["ab  cd ef"]) == ["ab cd..."]


def test_counts_follow_unicode(spark):
    assert values(spark, T.word_count("v"), ["héllo wörld x_1", None]) == [3, 0]
    assert values(spark, T.word_or_cjk_count("v"), ["it's a-b 日本 x"]) == [5]
    assert values(spark, T.wordish_count("v"), ["don't stop 日本語"]) == [3]
    assert values(spark, T.blank_split_count("v"), [" a  b　c ", "", None]) == [3, 0, 0]
    assert values(spark, T.keyword_tokens("v", extra_stop=("Acme",)), ["The acme EV 車 charging and Charging"]) == [["ev", "charging", "charging"]]


def test_extraction_summary(spark):
    df = spark.createDataFrame([("what is this? Somewhat",)], "v string")
    s = df.select(M.extraction_summary(
        "v", F.array(F.lit("a"), F.lit("b")), F.create_map().cast("map<string,string>"), F.lit(None).cast("array<string>")).alias("s")).first()[0]
    assert (s.word_count, s.question_signal_count, s.has_heading_structure, s.has_metadata, s.link_count) == (4, 5, True, False, 0)


def test_prose_keeps_lines_without_a_reason_to_go(spark):
    from citegrain.functions import markdown as M

    page = "\\n".join([
        "One sentence stays.", "ab", "We use a cookie here.", "see https://a.example/x now", "photo.JPG below", "a | b | c | d | e", "a | b | c | d | e.",
        "Home - Cars - Service - Price - Help", "![alt\ntext](x.png) after an image", "[named](https://a.example/b) link", "id=1 utm_source=z&k=2 kept",
    ])
    rows = spark.createDataFrame([(page,), (f"markdown='{page}'''",), (None,), ("markdown=plain",)], "t string")
    found = [r.c for r in rows.select(M.clean_for_scoring("t").alias("c")).collect()]
    prose = "One sentence stays.\nsee   now\na | b | c | d | e.\nafter an image\nnamed link\nid=1  &k=2 kept"
    assert found == [prose, prose, "", "markdown=plain"]
    reasons = spark.createDataFrame([(x,) for x in ("ok line", "no", "site map", "x.pdf", "a|b|c|d|e")], "s string")
    assert [r.r for r in reasons.select(M.drop_reason(F.col("s")).alias("r")).collect()] == [None, "short", "furniture", "asset", "menu"]
