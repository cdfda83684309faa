"""Operator 4: n-gram Jaccard join with Bayesian pruning of candidates.

A document is its set of five-word shingles (a text of fewer words is one shingle). Equal sets form a class that is
worked on once. MinHash values in bands bring candidates together; band buckets with the same members count once.

Pruning: two signatures are compared a few values at a time. With m of n values equal and a uniform prior, the
chance that the similarity reaches the threshold is P(Bin(n+1, t) ≤ m); a pair goes once it is below ``TOLERANCE``.

In a bucket, pruning is a search from member to unvisited members, so a group of near copies costs one comparison
each and leaves a spanning forest, never all its pairs. Connected forests are clusters. Within clusters every pair is
pruned again and the rest verified exactly on shingle sets; tasks hand back counts and a spanning forest of the
verified links. Buckets and clusters beyond ``CHUNK`` members are dealt out as pairs of chunks, so none meets in one
task. No partner is capped. With 32 bands of 4 values a pair of similarity 0.8 shares no bucket with a probability of
5e-8, and pruning drops it with one of about ``TOLERANCE``; sets are compared by 64-bit hashes of their shingles.

Defined results: null and blank texts have no shingles, no links and are classes of their own; ``class_id`` is the
smallest id of a document's group of linked documents, its own if it has no links; repeated rows are copies and link
to each other; null ids are allowed; an empty table gives no rows; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from citegrain.llm.common import blocks, byte_values, discard, identified, mixed, stored, to_arrow

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
CHUNK = 512
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Shingles whose hashes are taken through all functions at once; keeps the arrays in the processor's cache.
MINHASH_BLOCK = 40_000


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; forgets when large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_word_hashes = WordHashes()


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(codes))
    size = len(codes) - n + 1
    rolling = codes[:size].copy()
    for step in range(1, n):
        rolling = rolling * _FACTOR + codes[step : step + size]
    return np.unique(mixed(rolling + np.uint64(n)))


def set_name(found: np.ndarray) -> str:
    """A 128-bit name of a set of shingle hashes."""
    a = int(mixed(found).sum(dtype=np.uint64))
    b = int(mixed(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return f"{a:016x}{b:016x}"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * VALUES + 1))
    return (seeds[:VALUES] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds[VALUES:] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    out = np.empty((len(sets), VALUES), np.uint32)
    flips, factors = _functions()
    for start, stop in blocks([len(s) for s in sets], MINHASH_BLOCK):
        flat = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[start : stop - 1]])
        for k in range(VALUES):
            out[start:stop, k] = np.minimum.reduceat((flat ^ flips[k]) * factors[k], starts)
    return out


@functools.lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Per step of compared values the fewest matches with which a pair stays."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, others: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Positions in ``others`` that may reach the threshold with ``one``: values are compared step by step."""
    left = np.arange(len(others))
    matches = np.zeros(len(others), np.int32)
    for i, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (others[left, part] == one[part]).sum(axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def grouped(batches, n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first columns, as tables; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
        start = 0
        for i, found in enumerate(keys):
            if found != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, key = [], i, found
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def named(rows: DataFrame) -> DataFrame:
    """Id, name of the shingle set (null without shingles), MinHash values and identity of each identified row."""
    narrow = rows.select("id", "text", "__file", "__row")
    schema = T.StructType([narrow.schema["id"], *T.StructType.fromDDL("name string, values binary, __file long, __row long").fields])
    target = to_arrow(schema)

    def work(batches):
        for batch in batches:
            texts = byte_values(batch.column(1))
            for start, stop in blocks(list(map(len, texts))):
                sets = [shingles(t) for t in texts[start:stop]]
                full = [s for s in sets if len(s)]
                found = iter(signatures(full)) if full else iter(())
                names = [set_name(s) if len(s) else None for s in sets]
                values = [next(found).tobytes() if len(s) else None for s in sets]
                ids, files, numbers = (batch.column(i).slice(start, stop - start) for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays([ids.cast(target.field(0).type), pa.array(names, pa.string()), pa.array(values, pa.binary()), files, numbers], schema=target)

    return narrow.mapInArrow(work, schema)


def band_keys(classes: DataFrame) -> DataFrame:
    """A row per class and band: the key of the band's values."""

    def work(batches):
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]).copy()
            for r in range(ROWS):
                key = mixed(key * _FACTOR + values[:, :, r])
            names = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), names], names=["key", "name"])

    return classes.select("name", "values").mapInArrow(work, "key long, name string")


def chunk_pairs(rows: DataFrame, key: str, size: str, chunk: int) -> DataFrame:
    """Deal the members of a group out as pairs of chunks; a group of at most ``chunk`` members is one pair (0, 0).

    Every two members meet in a pair (i, j), i < j, of their chunks or of their chunk and a neighbouring one.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / chunk)).cast("int")
    rows = rows.withColumn("n_chunks", n).withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("n_chunks")).cast("int"))
    other = F.explode(F.when(F.col("n_chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("n_chunks") - 1), F.col("chunk"))))
    rows = rows.withColumn("other", other)
    return rows.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))


def forest_edges(values: np.ndarray, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that pruning leaves: a search that compares a member with unvisited ones only."""
    edges, left = [], np.arange(len(values))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = survivors(values[one], values[left], threshold, tolerance)
            edges += [(one, other) for other in left[hit]]
            queue += left[hit].tolist()
            left = np.delete(left, hit)
    return edges


def candidate_edges(classes: DataFrame, keys: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """Spanning forests of the unpruned pairs of all buckets of the band keys: columns a and b."""
    h = F.xxhash64("name")
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 20)).alias("s"), F.bit_xor(h).alias("x")).where("n > 1")
    once = buckets.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n")
    members = keys.join(once, "key").join(classes.select("name", "values"), "name")
    dealt = chunk_pairs(members, "key", "n", chunk).select("key", "i", "j", "name", "values")

    def work(batches):
        for group in grouped(batches, 3):
            names = group.column(3).to_pylist()
            values = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint32).reshape(-1, VALUES)
            edges = forest_edges(values, threshold, tolerance)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[a] for a, _ in edges], pa.string()), pa.array([names[b] for _, b in edges], pa.string())], names=["a", "b"],
            )

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(work, "a string, b string")


def components(edges: DataFrame, label: str) -> DataFrame:
    """Node and smallest node of its connected component, for the nodes of edges a–b: stars, turn and turn about.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones; it ends when all
    edges point to the components' smallest nodes. Edges stay a distributed table, stored after each round.
    """
    def state(e):
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)).alias("s")).first()
        return row["n"], row["s"]

    # from here on a is the larger end
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # both sides of a join are stored, so that Spark can split the edges of a frequent node
        smallest = stored(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m")), label)
        large = both.join(smallest, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, label)
        next_smallest = stored(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")), label)
        ends = large.join(next_smallest, F.col("a") == F.col("k")).select("a", "b", "m")
        small = ends.select("a", F.col("m").alias("b")).unionByName(ends.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        spent, edges = (edges, smallest, large, next_smallest), stored(small.distinct(), label)
        discard(*spent)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold exactly; ``left`` is sorted."""
    out = np.zeros(len(left), bool)
    if not len(left):
        return out
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    own = [flat[a : a + n] for a, n in zip(starts, sizes)]
    present = np.zeros(flat.max() + 1, np.int32)
    cuts = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(left))):
        one, partners = left[a], right[a:b]
        present[own[one]] = 1
        for start, stop in blocks(sizes[partners].tolist(), 1_000_000):
            part = partners[start:stop]
            common = np.add.reduceat(present[np.concatenate([own[p] for p in part])], np.cumsum(sizes[part]) - sizes[part])
            # exact comparison of common / union with the threshold, without rounding the quotient
            out[a + start : a + stop] = common >= threshold * (sizes[one] + sizes[part] - common) - 1e-9
        present[own[one]] = 0
    return out


def links(texts: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """Verified links within clusters: rows (name, other, docs, texts); other is null in rows that carry counts."""
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n_members"))
    # a class has the text of one row, whatever ids its documents have
    own = classes.select(F.col("name").alias("node"), "copies", F.col("at.__file").alias("f"), F.col("at.__row").alias("r"))
    members = clusters.join(sizes, "root").join(own, "node").withColumnRenamed("node", "name")
    rows = texts.select("__file", "__row", "text").join(members, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r")))
    dealt = chunk_pairs(rows, "root", "n_members", chunk).select("root", "i", "j", "chunk", "n_chunks", "name", "copies", "text")

    def work(batches):
        for group in grouped(batches, 3):
            i, j, n_chunks = group.column(1)[0].as_py(), group.column(2)[0].as_py(), group.column(4)[0].as_py()
            names, copies, chunks = group.column(5).to_pylist(), group.column(6).to_pylist(), group.column(3).to_pylist()
            if len(names) < 2:
                continue
            sets = [shingles(text or b"") for text in group.column(7).combine_chunks().cast(pa.binary()).to_pylist()]
            weight, side = np.array(copies, np.int64), np.array(chunks)
            values = signatures(sets)
            pairs_a, pairs_b = [], []
            for one in range(len(names) - 1):
                rest = one + 1 + survivors(values[one], values[one + 1 :], threshold, tolerance)
                if n_chunks > 1:
                    # two members of one chunk count in one of the pairs that the chunk takes part in
                    mine = (j == i + 1) if side[one] == i else (j == n_chunks - 1 and i == j - 1)
                    rest = rest[(side[rest] != side[one]) | mine]
                pairs_a.append(np.full(len(rest), one))
                pairs_b.append(rest)
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            ok = verify(sets, a, b, threshold)
            a, b = a[ok], b[ok]
            docs_of = np.bincount(a, weights=weight[b], minlength=len(names)) + np.bincount(b, weights=weight[a], minlength=len(names))
            texts_of = np.bincount(a, minlength=len(names)) + np.bincount(b, minlength=len(names))
            has = np.flatnonzero(texts_of)
            tree = spanning(a, b, len(names))
            yield pa.RecordBatch.from_arrays([
                pa.array([names[k] for k in has] + [names[x] for x, _ in tree], pa.string()),
                pa.array([None] * len(has) + [names[y] for _, y in tree], pa.string()),
                pa.array(np.concatenate([docs_of[has].astype(np.int64), np.zeros(len(tree), np.int64)])),
                pa.array(np.concatenate([texts_of[has].astype(np.int64), np.zeros(len(tree), np.int64)])),
            ], names=["name", "other", "docs", "texts"])

    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(work, "name string, other string, docs long, texts long")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the edges a–b."""
    root, tree = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            tree.append((x, y))
    return tree


def classes_of(rows: DataFrame) -> DataFrame:
    """Classes of equal shingle sets: name, smallest id, number of copies, MinHash values, identity of the row with that id."""
    at = F.min(F.struct(F.col("id").isNull(), "id", "__file", "__row")).alias("at")
    return rows.where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"), at)


def linked_classes(texts: DataFrame, classes: DataFrame, threshold: float, tolerance: float, chunk: int) -> DataFrame:
    """Per class with links: name, root class of its group, smallest id of the group, linked documents and texts."""
    keys = stored(band_keys(classes), "band-keys")
    clusters = components(candidate_edges(classes, keys, threshold, tolerance, chunk), "candidate-clusters")
    discard(keys)
    found = stored(links(texts, classes, clusters, threshold, tolerance, chunk), "links")
    roots = components(found.where("other is not null").select(F.col("name").alias("a"), F.col("other").alias("b")), "link-components")
    counts = found.groupBy("name").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    members = roots.join(classes.select(F.col("name").alias("node"), "id"), "node")
    groups = members.groupBy("root").agg(F.min("id").alias("group_id"))
    out = stored(members.join(groups, "root").join(counts, F.col("node") == F.col("name")).select("name", "root", "group_id", "docs", "texts"), "linked-classes")
    discard(found)
    return out


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK,
) -> DataFrame:
    """Class id, linked documents (copies included) and linked different texts of each document."""
    texts = identified(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(named(texts), "minhash")
    classes = stored(classes_of(rows), "classes")
    linked = linked_classes(texts, classes, threshold, tolerance, chunk)
    per_class = classes.select("name", "id", "copies").join(linked, "name", "left").select(
        "name", F.coalesce("group_id", "id").alias("class_id"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        F.col("id").alias("copy_of"),
    )
    found = rows.select(F.col("id").alias(id_col), "name").join(per_class, "name", "left")
    return found.select(
        id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("copy_of", F.col(id_col)).alias("copy_of"),
    )


def one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, chunk: int = CHUNK,
) -> DataFrame:
    """The documents without their near copies: of each group the one with the smallest id stays, with its own columns.

    Documents without shingles belong to no group and all stay.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    rows = identified(docs, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), columns)
    marks = stored(named(rows), "minhash")
    classes = stored(classes_of(marks), "classes")
    linked = linked_classes(rows, classes, threshold, tolerance, chunk)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("name"))
    ranked = linked.select("name", "root").join(classes.select("name", "id"), "name")
    leaders = ranked.groupBy("root").agg(F.min_by("name", order).alias("leader"))
    gone = ranked.join(leaders, "root").where("name <> leader").select("name")
    stay = classes.join(gone, "name", "left_anti").select("at.__file", "at.__row").unionByName(marks.where("name is null").select("__file", "__row"))
    stay = stay.withColumnsRenamed({"__file": "f", "__row": "r"})
    return rows.join(stay, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r"))).select("__doc.*")
