"""Operators 11 to 13 against brute force, SQL and awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_llm_operators import EXTRA, SF, awkward_rows, frame

from citegrain.llm import merkle_manifest, period_runs, queries, stream_dedup

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, awkward_rows()).select("*", *[F.lit("x").alias(c) for c in (*EXTRA, "digest", "at", "entries", "tree", "pos", "_metadata")])


# --- 11 ----------------------------------------------------------------------------------

def groups_by_hand(rows):
    """(id, text) rows → counted (id, keep_id, group_size, kept) rows."""
    groups, out = {}, Counter()
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    for members in groups.values():
        top = max((m for m in members if m is not None), default=None)
        for i, m in enumerate(sorted(members, key=lambda m: (m is not None, m or 0))):
            out[m, top, len(members), i == len(members) - 1] += 1
    return out


def groups_found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def test_stream_dedup_on_awkward_rows(spark, awkward, tmp_path):
    awkward.write.parquet(str(tmp_path / "t"))
    expected = groups_by_hand((r[0], r[1]) for r in awkward_rows())
    assert groups_found(stream_dedup.deduplicate(spark, str(tmp_path / "t"))) == expected


def test_stream_dedup_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "t"))
    assert stream_dedup.deduplicate(spark, str(tmp_path / "t")).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_stream_goes_on_from_its_state_and_compares_bytes(spark, tmp_path, weak):
    """Three loads, small batches; with a digest of one of two values most hits differ in their bytes."""
    rng = random.Random(3)
    rows = [(rng.choice([i, i, None]), rng.choice(["a", "b", "c", "", None, f"own {i}"])) for i in range(120)]
    options = {"digest": lambda text: F.substring(F.md5(text), 1, 1).cast("binary")} if weak else {}
    path = str(tmp_path / "t")
    for load in range(3):
        part = spark.createDataFrame(rows[load::3], "doc_id long, text string")
        part.repartition(3).write.mode("append").parquet(path)
        tool = stream_dedup.Deduplicator(spark, path, str(tmp_path / "state"), batch_bytes=1, **options).advance()
        seen = [r for i in range(load + 1) for r in rows[i::3]]
        assert groups_found(tool.report()) == groups_by_hand(seen)
    state = tool.state()
    assert state.agg(F.sum("n")).first()[0] == len(rows)
    assert tool.collisions(state).isEmpty() == (not weak)
    commits = len(os.listdir(tmp_path / "state" / "commits"))
    tool.advance()  # nothing new: nothing is read or counted again
    assert len(os.listdir(tmp_path / "state" / "commits")) == commits


# --- 12 ----------------------------------------------------------------------------------

def runs_by_hand(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s = i - q
            if j - s >= max(6, 4 * q) and not any(all(words[k] == words[k - p] for k in range(s + p, j)) for p in range(1, q)):
                out.append((s, j - s, q))
            i = max(j, i) + (j == i)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_words(rng):
    letters = "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 5, 20])]
    words = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 6, 7, 8, 12, 30, 90]))]
    for _ in range(rng.randint(0, 3)):
        if len(words) > 4:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 3))
            for i in range(a + p, rng.randint(a, len(words))):
                words[i] = words[i - p]
    if rng.random() < 0.3:
        words += ([rng.choice("ab") for _ in range(rng.randint(1, 6))] * rng.randint(3, 9) + ["z"]) * rng.randint(1, 6)
    return words


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 10))]
        found = period_runs.runs_of_texts([" ".join(t).encode() if t else None for t in texts])
        for words, runs, collapsed in zip(texts, found["runs"], found["collapsed"]):
            expected = runs_by_hand(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == expected
            gone = {i for s, n, q in expected for i in range(s + q, s + n)}
            assert collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_long_texts_take_no_square_time():
    one = period_runs.runs_of_texts([b"x " * 400_000])
    assert one["runs"][0] == [{"start": 0, "length": 400_000, "period": 1}] and one["collapsed"] == ["x"]
    rng = random.Random(2)
    block = [str(rng.randrange(10**6)) for _ in range(50_000)]
    found = period_runs.runs_of_texts([" ".join(["y", *block * 5, "y"]).encode()])
    assert found["runs"][0] == [{"start": 1, "length": 250_000, "period": 50_000}]


def test_runs_on_awkward_rows(spark, awkward):
    rows = period_runs.periodic_runs(awkward).withColumn("best", period_runs.most_repeated(F.col("runs"))).collect()
    found = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["best"] and tuple(r["best"])) for r in rows)
    expected = Counter()
    for r in awkward_rows():
        words = words_of(r[1])
        runs = runs_by_hand(words) if len(words) < 1000 else []
        expected[r[0], len(words), tuple(runs), max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)] += 1
    assert found == expected
    assert period_runs.periodic_runs(frame(spark, [])).count() == 0


def test_tail_of_blank_texts_stays(spark, awkward):
    out = period_runs.with_periodic_tail(awkward, F.lit(True), lambda n: (n / 3).cast("int"), lambda n, a: ((n - a) / 4).cast("int") + 1)
    assert out.columns == awkward.columns
    for r in out.collect():
        words = words_of(dict((x[0], x[1]) for x in awkward_rows()).get(r["doc_id"]))
        if r["doc_id"] is not None and words:
            n, a = len(words), len(words) // 3
            p = (n - a) // 4 + 1
            assert r["text"].split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


# --- 13 ----------------------------------------------------------------------------------

def leaf_by_hand(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def levels_by_hand(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_by_hand(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        i //= 8
    return out


def manifest_by_hand(rows):
    """Rows (id, text, lang, source, n_chars) → counted result rows."""
    trees, out = {}, Counter()
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_by_hand(r, r[1]), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {}
    for t in names:
        trees[t].sort(key=lambda x: x[:3])
        levels[t] = levels_by_hand([x[2] for x in trees[t]])
    top = levels_by_hand([levels[t][-1][0] for t in names])
    for k, t in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(trees[t]):
            path, node = path_by_hand(levels[t], i) + path_by_hand(top, k), leaf
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf_by_hand(r, re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
            for left, right in path:
                node = sha(left, node, right)
            out[r[0], leaf, levels[t][-1][0], top[-1][0], sha(*[a + b for a, b in path]), node, node == top[-1][0]] += 1
    return out


def manifest_found(df):
    found = merkle_manifest.manifest(df, queries.id_hash() % 3 == 0).withColumn("proof", merkle_manifest.proof_digest(F.col("path")))
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")) for r in found.collect())


def test_manifest_on_awkward_rows(spark, awkward):
    rows = [(*r[:1], r[1] if r[1] is None else r[1] + " ÀÉ Z", *r[2:]) for r in awkward_rows()]
    assert manifest_found(frame(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("tree", "id", "node", "forged", "slot", "path")])) == manifest_by_hand(rows)
    assert manifest_found(awkward) == manifest_by_hand(awkward_rows())


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65, 512, 513, 4097])
def test_manifest_of_trees_of_any_size(spark, n):
    """One tree of n rows and n trees of a row or two, over several rounds of blocks."""
    rows = [(i, "T", "en", "s", 1) for i in range(n)]
    assert manifest_found(frame(spark, rows)) == manifest_by_hand(rows)
    if n in (9, 513):
        rows = [(i, "T", f"l{i}", "s", 1) for i in range(n)] + [(n, "U", None, None, None), (n + 1, None, "l1", None, None)]
        assert manifest_found(frame(spark, rows)) == manifest_by_hand(rows)
