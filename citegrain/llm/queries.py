"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from citegrain.llm import (
    bm25_search, byte_bpe, jaccard_join, language_filters, merkle_manifest, mixing, period_runs, repetition, sharding, stream_dedup, suffix_dedup, token_files,
    url_templates,
)
from citegrain.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_OF_DOCUMENT = 1
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
SHARDS = 16
TOP_K = 10


def query(fn):
    """Register a query under its function's name."""
    QUERIES[fn.__name__] = fn
    return fn


def held_out(id_col: str = "doc_id"):
    """Documents that no model may learn from; those without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op1_language_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    docs = read_table(spark, sf, "documents")
    model = language_filters.learn(docs, ~held_out())
    found = language_filters.predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin")


@query
def op2_url_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's URL, by rule or by template."""
    return url_templates.judge(read_table(spark, sf, "pages"), URL_RULES)


@query
def op3_kd_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(read_table(spark, sf, "documents"), SHARDS)


@query
def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Group of near copies and number of links of every document."""
    return jaccard_join.jaccard_join(read_table(spark, sf, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document that lie in strings found elsewhere too."""
    return suffix_dedup.report(read_table(spark, sf, "documents"))


@query
def op6_bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best other documents for every document whose id is divisible by 20, its whole text as query."""
    return bm25_search.search(read_table(spark, sf, "documents"), F.col("doc_id") % 20 == 0, TOP_K)


@query
def op7_repetition_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    return repetition.repetition(read_table(spark, sf, "documents"))


@query
def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token ids, written as addressable codes and read back."""
    return token_files.read_documents(token_files.write_segments(read_table(spark, sf, "documents"), WORD_TOKENIZER, END_OF_DOCUMENT))


@query
def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip of every document through byte-level BPE."""
    return byte_bpe.round_trip(read_table(spark, sf, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


@query
def op10_pareto_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(read_table(spark, sf, "documents"))


def id_hash(id_col: str = "doc_id"):
    """Unsigned CRC-32 of the decimal id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


@query
def op11_stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Group and survivor of every document among equal texts, by a stream with state on disk."""
    found = stream_dedup.deduplicate(spark, f"{sf}/documents.parquet")
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query
def op12_period_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of every document; every tenth one, by hash, is given a periodic tail first."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", id_hash().alias("h"))
    g = F.floor(F.col("h") / 10)
    docs = period_runs.with_periodic_tail(
        docs, F.col("h") % 10 == 0, lambda n: (g % n).cast("int"), lambda n, a: (1 + F.floor((n - a) / (3 + g % 8))).cast("int"),
    )
    found = period_runs.periodic_runs(docs).withColumn("best", period_runs.most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether tampering with every third one is seen."""
    found = merkle_manifest.manifest(read_table(spark, sf, "documents"), id_hash() % 3 == 0)
    return found.withColumn("proof_sha256", merkle_manifest.proof_digest(F.col("path"))).drop("path")


ORACLE["op10_pareto_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
lv AS (SELECT *, length(bin(size)) AS level, 1.0::DOUBLE + length(bin(size)) / 16.0::DOUBLE AS lw FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM lv GROUP BY source),
f AS (
  SELECT *, row_number() OVER o AS pos,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size <= w * share THEN 2 * source_size::DOUBLE
              ELSE w * (min_by(share, pos) FILTER (WHERE 2 * source_size > w * share) OVER ()) END AS target
  FROM f),
l AS (
  SELECT l.source, level, lw, level_size, source_size, target,
         coalesce((target - 2 * coalesce(sum(level_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / nullif(sum(level_size * lw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 0) AS factor
  FROM (SELECT source, level, lw, sum(size)::BIGINT AS level_size FROM lv GROUP BY ALL) l JOIN t ON l.source IS NOT DISTINCT FROM t.source
  WINDOW o AS (PARTITION BY l.source ORDER BY level DESC)),
c AS (
  SELECT *, CASE WHEN factor * lw >= 2 THEN 2.0
                 ELSE least(2.0, greatest(0.0, (max_by(factor, level) FILTER (WHERE factor * lw < 2) OVER (PARTITION BY source)) * lw)) END AS copies
  FROM l),
p AS (
  SELECT *, floor(copies) AS certain, copies - floor(copies) AS pi,
         target - sum(floor(copies) * level_size) OVER (PARTITION BY source) AS open
  FROM c),
r AS (
  SELECT doc_id, lv.source, size, source_size, target, certain, pi, open,
         CASE WHEN pi > 0 THEN u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi) END AS t
  FROM lv JOIN p ON lv.source IS NOT DISTINCT FROM p.source AND lv.level = p.level),
k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY t) AS upto, sum(size) OVER (PARTITION BY source, t) AS peers
  FROM r WHERE pi > 0 AND size > 0)
SELECT doc_id, size, source_size, target, (size * (certain + CASE WHEN 2 * upto - peers <= 2 * open THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
UNION ALL
SELECT doc_id, size, source_size, target, (size * certain)::BIGINT FROM r WHERE NOT (pi > 0 AND size > 0)
"""

ORACLE["op6_bm25_search"] = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, count(*)::DOUBLE AS n_words FROM w GROUP BY ALL),
g AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n_docs, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM documents) AS mean_words),
f AS (SELECT term, floor(4096.0::DOUBLE * ln(1.0::DOUBLE + (n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)))::BIGINT AS idf FROM p, g GROUP BY term, n_docs),
x AS (
  SELECT p.doc_id, term, floor(4096.0::DOUBLE * (tf * (1.2::DOUBLE + 1.0::DOUBLE)
           / (tf + 1.2::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * n_words / mean_words))))::BIGINT AS weight
  FROM p JOIN l USING (doc_id), g),
s AS (
  SELECT q.doc_id AS query_id, x.doc_id, sum(x.weight * f.idf)::BIGINT AS score
  FROM p q JOIN x USING (term) JOIN f USING (term) WHERE q.doc_id % 20 = 0 AND q.doc_id <> x.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, rank::INTEGER AS rank, doc_id, score / 16777216.0::DOUBLE AS score FROM r WHERE rank <= 10
"""

ORACLE["op11_stream_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Unsigned CRC-32 of the decimal doc_id, byte by byte and bit by bit.
ID_HASH_SQL = """xor(4294967295::BIGINT, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k::INTEGER, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, bit: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

ORACLE["op12_period_runs"] = rf"""
WITH d AS (
  SELECT doc_id, {ID_HASH_SQL} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS original FROM documents),
a AS (SELECT *, len(original)::BIGINT AS n, h % 10 = 0 AND len(original) > 0 AS tailed, (h // 10) % greatest(len(original), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (
  SELECT doc_id, n, i, original[(CASE WHEN tailed AND i >= a THEN a + (i - a) % p ELSE i END) + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
s AS (
  SELECT doc_id, lag AS period, min(i) - lag AS start, count(*) + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM m) GROUP BY doc_id, lag, island
  HAVING count(*) + lag >= greatest(6, 4 * lag)),
r AS (
  SELECT * FROM s WHERE NOT EXISTS (
    SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.period < s.period AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed,
         arg_min({{'start': start, 'length': length, 'period': period}}, {{'k': -length::DOUBLE / period, 's': start, 'p': period}}) AS best
  FROM r GROUP BY doc_id),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w WHERE NOT EXISTS (
    SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       ((1000 * best.length) // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _merkle_sql(levels: int = 8) -> str:
    """Levels of the trees per language, then of the tree of their roots; 8 ** levels rows a tree at most."""
    field = "coalesce(concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    changed = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""d AS (
  SELECT doc_id, lang AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, {leaf('text')} AS node,
         CASE WHEN {ID_HASH_SQL} % 3 = 0 THEN {leaf(changed)} ELSE {leaf('text')} END AS folded FROM documents)""",
        "l0 AS (SELECT tree, pos, node FROM d)"]

    def climb(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}{k + 1} AS (
  SELECT tree, pos // 8 AS pos, CASE WHEN max(alone) THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) = 1 AS alone FROM {name}{k}) GROUP BY tree, pos // 8)""")

    def fold(name: str, nodes: str, start: str) -> str:
        now = start
        for k in range(levels):
            parts.append(f"""{nodes}_s{k} AS (
  SELECT x.tree, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lhs,
         coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rhs, (SELECT count(*) FROM {nodes}{k} z WHERE z.tree IS NOT DISTINCT FROM x.tree) = 1 AS alone
  FROM {nodes}{k} x JOIN {nodes}{k} y ON x.tree IS NOT DISTINCT FROM y.tree AND x.pos // 8 = y.pos // 8 GROUP BY x.tree, x.pos)""")
            parts.append(f"""{name}{k} AS (
  SELECT f.* REPLACE (CASE WHEN alone THEN folded ELSE sha256(lhs || folded || rhs) END AS folded, f.pos // 8 AS pos, proof || lhs || rhs AS proof)
  FROM {now} f JOIN {nodes}_s{k} s ON f.tree IS NOT DISTINCT FROM s.tree AND f.pos = s.pos)""")
            now = f"{name}{k}"
        return now

    climb("l")
    parts.append(f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, tree AS name, node FROM l{levels})")
    climb("t")
    parts.append("f AS (SELECT doc_id, tree, pos, node AS leaf, folded, '' AS proof FROM d)")
    low = fold("f", "l", "f")
    parts.append(f"g AS (SELECT doc_id, t0.tree, t0.pos, leaf, t0.node AS subroot, folded, proof FROM {low} x JOIN t0 ON x.tree IS NOT DISTINCT FROM t0.name)")
    high = fold("g", "t", "g")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t{levels}.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t{levels}.node AS verified
FROM {high} x, t{levels}"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
