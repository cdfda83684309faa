"""Text and Markdown queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import in_list, query, quoted, table
from citegrain.functions import markdown as M
from citegrain.functions import patterns as P
from citegrain.functions import text as T
from citegrain.operators import json_walks

WS = P.WS
LINES = f"string_split_regex(text, '{P.LINE_BREAK}')"


def compact_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def block_sql(c: str) -> str:
    t = f"replace({c}, chr(160), ' ')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n[ \\t]+', chr(10), 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def count_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(pattern)}))"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def line_key_sql(c: str) -> str:
    t = f"regexp_replace({c}, 'https?://{P.NOT_WS}+', '', 'g')"
    t = f"regexp_replace({t}, {quoted(M.LINE_NOISE)}, ' ', 'g')"
    return strip_sql(f"lower({t})")


# RE2 spells the flags of the shared patterns without Java's (?d) and (?u).
def re2(pattern: str) -> str:
    return pattern.replace("(?md)", "(?m)").replace("(?iu)", "(?i)")


PIPES = "len(ln) - len(replace(ln, '|', ''))"
TABLE_LINES = f"len(list_filter({LINES}, lambda ln: {PIPES} >= 2))"


@query(f"""
SELECT doc_id, {count_sql('text', P.WORD + '+')} AS words, {count_sql('text', P.WORD_OR_CJK)} AS word_or_cjk,
       {count_sql('text', P.CJK)} AS cjk, {count_sql('text', P.LATIN_WORD)} AS latin,
       {count_sql('text', P.LATIN_WORD)} + {count_sql('text', P.CJK)} // 2 AS wordish,
       {count_sql('text', P.NOT_WS + '+')} AS blank_split
FROM documents""")
def doc_word_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.word_count("text").alias("words"), T.word_or_cjk_count("text").alias("word_or_cjk"),
        T.cjk_char_count("text").alias("cjk"), T.latin_word_count("text").alias("latin"),
        T.wordish_count("text").alias("wordish"), T.blank_split_count("text").alias("blank_split"),
    )


@query(f"""
SELECT doc_id, {count_sql('text', re2(M.HEADING))} AS headings, {count_sql('text', re2(M.BULLET))} AS bullets,
       {count_sql('text', '[?？]')} AS question_marks, {TABLE_LINES} AS table_lines,
       {count_sql('text', M.QUESTION_SPAN)} AS questions, {count_sql('text', 'https?://')} AS raw_urls
FROM documents""")
def doc_shape_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", M.heading_count("text").alias("headings"), M.bullet_count("text").alias("bullets"),
        M.question_mark_count("text").alias("question_marks"), M.table_line_count("text").alias("table_lines"),
        M.question_count("text").alias("questions"), M.count_of("text", "https?://").alias("raw_urls"),
    )


@query(f"""
WITH l AS (SELECT doc_id, list_filter(list_transform({LINES}, lambda ln: lower({compact_sql('ln')})), lambda ln: len(ln) > 20) AS b FROM documents)
SELECT doc_id, CASE WHEN len(b) = 0 THEN 0.0 ELSE round_even(1 - len(list_distinct(b))::DOUBLE / len(b), 3) END AS ratio FROM l""")
def duplicate_block_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.duplicate_block_ratio("text").alias("ratio"))


@query(f"""
SELECT doc_id, md5({compact_sql('text')}) AS compact,
       md5(CASE WHEN len({compact_sql('text')}) > 500 THEN rtrim(left({compact_sql('text')}, 500)) || '...' ELSE {compact_sql('text')} END) AS limited,
       md5({block_sql('text')}) AS block,
       md5(CASE WHEN len({compact_sql('text')}) > 300 THEN rtrim(left({compact_sql('text')}, 300)) ELSE {compact_sql('text')} END) AS cleaned,
       md5(CASE WHEN len(text) > 400 THEN regexp_replace(left(text, 400), '{WS}+$', '') || chr(10) || '...[truncated]' ELSE text END) AS cut
FROM documents""")
def compact_forms(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", F.md5(T.compact("text")).alias("compact"), F.md5(T.compact_limited("text", 500)).alias("limited"),
        F.md5(T.compact_block("text")).alias("block"), F.md5(T.clean_value("text", 300)).alias("cleaned"),
        F.md5(T.truncate("text", 400)).alias("cut"),
    )


@query(f"""
SELECT doc_id, 'A & B <' || lang || '> © ' || source AS plain FROM documents""")
def entity_cleanup(spark, sf):
    coded = F.concat(F.lit("A &amp;  B &lt;"), "lang", F.lit("&gt;\n&copy; "), "source")
    return table(spark, sf, "documents").select("doc_id", T.clean_value(coded).alias("plain"))


@query(f"""
WITH l AS (SELECT doc_id, unnest({LINES}) AS raw, generate_subscripts({LINES}, 1) AS pos FROM documents),
b AS (SELECT doc_id, pos, {block_sql('raw')} AS ln FROM l),
k AS (SELECT doc_id, pos, ln, CASE WHEN ln = '' THEN 'blank:' || pos
        WHEN ln[1] = '#' THEN 'heading:' || {line_key_sql('ln')} ELSE {line_key_sql('ln')} END AS key FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn FROM k WHERE len(key) >= 2),
j AS (SELECT doc_id, string_agg(ln, chr(10) ORDER BY pos) AS doc FROM r WHERE rn = 1 GROUP BY doc_id)
SELECT d.doc_id, md5({block_sql("coalesce(j.doc, '')")}) AS deduped, len({block_sql("coalesce(j.doc, '')")}) AS chars
FROM documents d LEFT JOIN j USING (doc_id)""")
def line_dedupe(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", M.dedupe_lines("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("deduped"), F.length("t").alias("chars"))


# Documents carry few links and menus, so each gets some around its own text.
NOISY = r"""text || chr(10) || '![x](https://a.example/i.png) see [spec sheet](https://a.example/s.html) or https://b.example/q?utm_x=' || doc_id
  || chr(10) || 'Accept all cookies' || chr(10) || 'Home - Cars - Offers - Dealers - About ' || source || chr(10) || 'utm_campaign=' || source || ' range of ' || n_chars || ' units' || chr(10) || 'ab'"""


def _noisy(spark, sf):
    d = table(spark, sf, "documents")
    return d.withColumn("noisy", F.concat(
        "text", F.lit("\n![x](https://a.example/i.png) see [spec sheet](https://a.example/s.html) or https://b.example/q?utm_x="),
        F.col("doc_id").cast("string"), F.lit("\nAccept all cookies\nHome - Cars - Offers - Dealers - About "), "source",
        F.lit("\nutm_campaign="), "source", F.lit(" range of "), F.col("n_chars").cast("string"), F.lit(" units\nab"),
    ))


def clean_sql(c: str) -> str:
    t = f"replace({c}, '\\n', chr(10))"
    t = f"regexp_replace({t}, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g')"
    t = f"regexp_replace({t}, '\\[([^\\]]{{0,120}})\\]\\((https?://[^)]*)\\)', '\\1', 'g')"
    t = f"regexp_replace({t}, 'https?://{P.NOT_WS}+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b[A-Za-z0-9_%.-]*AdobeOrg[A-Za-z0-9_%.-]*\\b', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)\\b(?:utm_[a-z]+|srsltid|fbclid|gclid)=[^\\s&]+', ' ', 'g')"
    keep = (
        f"len(s) >= 3 AND NOT list_bool_or(list_transform([{in_list(M.BOILERPLATE_TERMS)}], lambda b: contains(lower(s), b)))"
        f" AND NOT regexp_matches(s, {quoted(M.ASSET_MARK)})"
        f" AND NOT ((len(s) - len(replace(s, '|', '')) >= 4 OR {count_sql('s', ' - ')} >= 4) AND NOT regexp_matches(s, '[。.!?]'))"
    )
    lines = f"list_transform(string_split_regex({t}, '{P.LINE_BREAK}'), lambda s: {strip_sql('s')})"
    return f"array_to_string(list_filter({lines}, lambda s: {keep}), chr(10))"


@query(f"""
SELECT doc_id, md5(t) AS cleaned, len(t) AS chars FROM (SELECT doc_id, {clean_sql('(' + NOISY + ')')} AS t FROM documents)""")
def clean_markdown(spark, sf):
    d = _noisy(spark, sf).select("doc_id", M.clean_for_scoring("noisy").alias("t"))
    return d.select("doc_id", F.md5("t").alias("cleaned"), F.length("t").alias("chars"))


# A number counts where no word character precedes it; RE2 has no look-behind, so the SQL
# takes the character before it into the match.
def numeric_count_sql(c: str) -> str:
    core = r"(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
    return f"len(regexp_extract_all({c}, '(?:^|[^\\p{{L}}\\p{{N}}_])' || {quoted(core)}))"


LINKS = f"regexp_extract_all(t, {quoted(M.LINK_TARGET)}, 1)"


@query(f"""
WITH d AS (SELECT doc_id, ({NOISY}) AS t FROM documents),
s AS (SELECT doc_id, t, string_split_regex(t, '{P.LINE_BREAK}') AS ls FROM d)
SELECT doc_id, len(t) AS markdown_chars, {count_sql('t', P.LATIN_WORD)} + {count_sql('t', P.CJK)} // 2 AS wordish_count,
       {count_sql('t', re2(M.HEADING))} AS heading_count, {count_sql('t', re2(M.BULLET))} AS bullet_count,
       len({LINKS}) AS link_count, {count_sql('t', M.IMAGE_TARGET)} AS image_count,
       len(list_filter({LINKS}, lambda u: contains(lower(u), '.pdf'))) AS pdf_link_count,
       len(list_filter(ls, lambda ln: {PIPES} >= 2)) >= 3 AS table_like,
       len(list_filter(ls, lambda ln: {PIPES} >= 2)) AS table_line_count, {count_sql('t', 'https?://')} AS raw_url_count,
       {numeric_count_sql('t')} AS numeric_fact_count, {count_sql('t', M.QUESTION_SPAN)} AS question_count,
       len(list_distinct(list_filter(list_transform(ls, lambda ln: {line_key_sql('ln')}), lambda k: k <> ''))) AS unique_line_count,
       {count_sql('t', M.IMAGE_ALT)} AS image_alt_count, array_to_string({LINKS}, ' ') AS links
FROM s""")
def markdown_metrics(spark, sf):
    d = _noisy(spark, sf).select("doc_id", M.markdown_metrics("noisy").alias("m"))
    names = (
        "markdown_chars", "wordish_count", "heading_count", "bullet_count", "link_count", "image_count", "pdf_link_count",
        "table_like", "table_line_count", "raw_url_count", "numeric_fact_count", "question_count", "unique_line_count",
        "image_alt_count",
    )
    return d.select("doc_id", *[f"m.{n}" for n in names], F.array_join("m.links_sample", " ").alias("links"))


# --- questions, numbers, dates ------------------------------------------------------------

ASKING = r"'# ' || regexp_replace(text, '\. ', '? ', 'g') || chr(10) || '- Is the ' || source || ' page good in ' || lang || '?'"
_NOISE = "|".join(M.literal(t) for t in M.QUESTION_NOISE)


def questions_sql(c: str) -> str:
    found = "list_concat(" + ", ".join(f"regexp_extract_all({c}, {quoted(re2(p))}, 1)" for p in M.QUESTION_PATTERNS[:2])
    found = f"list_concat({found}), regexp_extract_all({c}, {quoted(M.QUESTION_PATTERNS[2])}, 1))"
    keep = (
        f"NOT regexp_matches(lower(q), {quoted(_NOISE)}) AND NOT contains(left(q, len(q) - 1), '?')"
        f" AND ({count_sql('q', P.NOT_WS + '+')} >= 4 OR regexp_matches(q, '{M.LONG_CJK_RUN}'))"
    )
    return f"list_filter(list_transform({found}, lambda q: {compact_sql('q')}), lambda q: {keep})"


def distinct_in_order(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


@query(f"""
WITH d AS (SELECT doc_id, {questions_sql('(' + ASKING + ')')} AS q FROM documents)
SELECT doc_id, array_to_string({distinct_in_order('q')}, ' | ') AS questions FROM d""")
def doc_questions(spark, sf):
    asking = F.concat(
        F.lit("# "), F.regexp_replace("text", r"\. ", "? "), F.lit("\n- Is the "), "source", F.lit(" page good in "), "lang", F.lit("?")
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(M.real_questions(asking), " | ").alias("questions"))


SPECS = "text || ' Range ' || n_chars || ' km, price ¥' || (doc_id * 1000) || ' or ' || (doc_id % 97) || '% off until 2024/05 in x7 kW and ' || (n_chars % 7) || ' seats '"
# The look-arounds of the shared pattern as word boundaries: RE2 has no look-arounds.
NUMBER_RE2 = (
    r"(?i)(?:\B¥\s?\d[\d,]*(?:\.\d+)?\b|\b\d[\d,]*(?:\.\d+)?\s?(?:(?:km|kWh|kW|yen|seats?|L|litres?|mm|m|hours?|minutes?)\b"
    r"|(?:%|円|万円|年|ヶ月|か月|人|名|リットル|分|歳)\B))"
)


@query(f"""
WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all({SPECS}, {quoted(NUMBER_RE2)}),
              lambda x: NOT regexp_matches(lower(x), '{M.NUMBER_NOISE}')), lambda x: trim(x)) AS n FROM documents)
SELECT doc_id, array_to_string({distinct_in_order('n')}, ' | ') AS numbers FROM d""")
def numeric_mentions(spark, sf):
    specs = F.concat(
        "text", F.lit(" Range "), F.col("n_chars").cast("string"), F.lit(" km, price ¥"), (F.col("doc_id") * 1000).cast("string"),
        F.lit(" or "), (F.col("doc_id") % 97).cast("string"), F.lit("% off until 2024/05 in x7 kW and "),
        (F.col("n_chars") % 7).cast("string"), F.lit(" seats "),
    )
    return table(spark, sf, "documents").select("doc_id", F.array_join(M.numeric_mentions(specs), " | ").alias("numbers"))


DATED = "'Published ' || strftime(ts, '%Y-%m-%d') || chr(10) || 'on ' || strftime(ts, '%Y/%-m/%-d') || ' ' || event_type || chr(10) || '更新日: ' || strftime(ts, '%Y年%-m月%-d日') || chr(10) || '令和6年' || strftime(ts, '%-m月%-d日')"


@query(f"""
WITH d AS (SELECT event_id, {DATED} AS t FROM events),
f AS (SELECT event_id, list_transform(list_concat(list_concat(
        list_concat(regexp_extract_all(t, {quoted(M.DATE_PATTERNS[0])}), regexp_extract_all(t, {quoted(M.DATE_PATTERNS[1])})),
        list_concat(regexp_extract_all(t, {quoted(M.DATE_PATTERNS[2])}), regexp_extract_all(t, {quoted(M.DATE_PATTERNS[3])}))),
        regexp_extract_all(t, {quoted(M.DATE_PATTERNS[4])})), lambda x: {block_sql('x')}) AS n FROM d)
SELECT event_id, array_to_string({distinct_in_order('n')}, ' | ') AS dates FROM f""")
def visible_dates(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    fmt = lambda pattern: F.date_format("ts", pattern)
    dated = F.concat(
        F.lit("Published "), fmt("yyyy-MM-dd"), F.lit("\non "), fmt("yyyy/M/d"), F.lit(" "), "event_type",
        F.lit("\n更新日: "), fmt("yyyy年M月d日"), F.lit("\n令和6年"), fmt("M月d日"),
    )
    return e.select("event_id", F.array_join(M.visible_dates(dated), " | ").alias("dates"))


# --- tokens -------------------------------------------------------------------------------

KEYWORDS = f"regexp_extract_all(lower(text || ' ' || source), '[{P.TOKEN_CHARS}{P.PROLONGED_MARK}]+')"
STOP = in_list((*T.STOP_WORDS, "src1"))


@query(f"""
SELECT doc_id, md5(array_to_string(list_filter({KEYWORDS}, lambda t: len(t) > 1 AND NOT list_contains([{STOP}], t)), ' ')) AS tokens,
       len(list_filter({KEYWORDS}, lambda t: len(t) > 1 AND NOT list_contains([{STOP}], t))) AS n
FROM documents""")
def keyword_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.keyword_tokens("text", "source", extra_stop=(" SRC1 ",)).alias("k"))
    return d.select("doc_id", F.md5(F.array_join("k", " ")).alias("tokens"), F.size("k").alias("n"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[{P.TOKEN_CHARS}]+'), lambda t: len(t) >= 3))) AS token FROM documents)
SELECT token, count(*) AS documents FROM t GROUP BY token""")
def token_frequency(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(T.match_tokens("text")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("documents"))


TERMS = ("the", "DES", "ción", "sch", "warranty", "src")


@query(f"""
SELECT doc_id, {" + ".join(f"contains(lower(text), {quoted(t.lower())})::INT" for t in TERMS)} AS terms FROM documents""")
def term_presence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.terms_present("text", TERMS).alias("terms"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'none' WHEN role = 'user' THEN md5(text) ELSE role END AS first_text,
       CASE WHEN turn % 3 = 0 THEN 'x' || turn ELSE role END AS first_present
FROM conversations""")
def first_values(spark, sf):
    c = table(spark, sf, "conversations")
    a = F.when(F.col("role") == "user", F.lit(" \t\n")).otherwise(F.col("role"))
    b = F.when((F.col("role") == "user") & (F.col("turn") % 4 != 0), F.md5("text")).otherwise(F.lit(None).cast("string"))
    return c.select(
        "conv_id", "turn", F.coalesce(F.nullif(T.first_text(a, b), F.lit("")), F.lit("none")).alias("first_text"),
        T.first_present(F.when(F.col("turn") % 3 == 0, "").otherwise(F.lit(None)),
                        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x"), F.col("turn").cast("string"))), F.col("role")).alias("first_present"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN '0' WHEN (o_custkey % 1001) % 10 = 0 THEN ((o_custkey % 1001) // 10)::VARCHAR
         ELSE ((o_custkey % 1001) // 10)::VARCHAR || '.' || ((o_custkey % 1001) % 10)::VARCHAR END AS pct
FROM orders""")
def percent_text(spark, sf):
    value = F.when(F.col("o_custkey") % 50 != 0, (F.col("o_custkey") % 1001) / 10)
    return table(spark, sf, "orders").withColumn("v", value).select("o_orderkey", T.percent_text("v").alias("pct"))


# --- redaction ----------------------------------------------------------------------------

@query("""
SELECT event_id, 'api_key=[REDACTED],k=' || regexp_extract(props, '(\\d+)', 1) || ',session_Token=[REDACTED],type=' || event_type AS entries FROM events""")
def redact_map(spark, sf):
    e = table(spark, sf, "events")
    props = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("session_Token"), F.lit("s"), F.lit("type"), F.col("event_type")),
    )
    entries = F.array_sort(F.transform(F.map_entries(T.redact_map(props)), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return e.select("event_id", F.array_join(entries, ",").alias("entries"))


@query("""
SELECT event_id, '{"event":{"type":"' || event_type || '","password":"[REDACTED]"},"list":[{"my_access_token_x":"[REDACTED]","k":' || event_id || '}]}' AS doc FROM events""")
def redact_json(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct(
        F.struct(F.col("event_type").alias("type"), F.col("props").alias("password")).alias("event"),
        F.array(F.struct(F.lit("t").alias("my_access_token_x"), F.col("event_id").alias("k"))).alias("list"),
    )).alias("doc"))
    return json_walks.redact_json(e, "doc", ("event_id",)).select("event_id", "doc")
