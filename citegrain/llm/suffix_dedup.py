"""Operator 5: removal of repeated byte strings by a distributed difference-cover algorithm.

Every text is a sequence of UTF-8 bytes; a byte goes if a string of 200 bytes around it starts anywhere else too.
A suffix matters only by its first 200 bytes, so the recursion on triples ends there: words of 8 bytes are named,
then triples of words, triples of those, and a last triple that spans 200 bytes (``suffix_names``). Names are 64-bit
fingerprints instead of ranks, which each task finds alone; sorting by them brings equal prefixes together.

The cover is sampled by content: a 200-byte string belongs to the smallest name of a 72-byte gram in it. Two equal
strings therefore have a sample at the same distance wherever they lie, which is what a difference cover is for.
1. Sampled suffixes are brought together by their gram; samples whose gram is nowhere else are done.
2. Samples are told apart by the names of all their strings (``span``). Equal ones are decided: repeated. Samples
   whose gram has one span only need no more.
3. Remaining suffixes, those that start between samples of grams with several spans, are merged: one sample per span
   sends the names of its strings, keyed by gram and distance; sorted neighbours with equal names are repeated.
   A gram with many spans is dealt out by name, so no string in a large share of all texts meets in one task.
4. The repeated strings of a document are united to spans, and the rest of its bytes is kept.
A match takes equal 64-bit names of gram and of 200 bytes at equal distances.

Defined results: a null text is empty; texts under 200 bytes lose nothing; repeated rows lose all they share; an
empty table gives no rows; null and repeated ids are allowed, as rows are told apart by their place in the input;
other columns are not read by the report and stay as they are in the cleaned documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from citegrain.llm.common import blocks, byte_values, discard, identified, stored, to_arrow
from citegrain.llm.jaccard_join import grouped
from citegrain.llm.suffix_names import LENGTH, named, samples

# Spans of one gram beyond which its strings are dealt out by name.
SPANS_PER_TASK = 1000


def sampled(docs: DataFrame) -> DataFrame:
    """Samples of all texts: file, row, place (position, farthest and nearest string start), gram and span."""
    rows = docs.select("__file", "__row", "__text").where(F.octet_length("__text") >= LENGTH)

    def work(batches):
        for batch in batches:
            texts = byte_values(batch.column(2))
            for start, stop in blocks(list(map(len, texts))):
                found = [samples(t) for t in texts[start:stop]]
                doc_of = pa.array(np.repeat(np.arange(start, stop), [len(s["at"]) for s in found]))
                at, low, high, gram, span = (np.concatenate([s[k] for s in found]) for k in ("at", "low", "high", "gram", "span"))
                place = (at << 16) | ((at - low) << 8) | (at - high)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(doc_of), batch.column(1).take(doc_of), pa.array(place), pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)),
                ], names=["__file", "__row", "place", "gram", "span"])

    return rows.mapInArrow(work, "__file long, __row long, place long, gram long, span long")


def candidates(found: DataFrame) -> DataFrame:
    """Samples with a gram that is elsewhere too: whether their strings are known to repeat, and whether they must ask.

    Samples with equal spans are covered; where a gram has several spans, one sample of each sends its strings.
    """
    # both sides of the joins are stored, so that Spark can split the rows of a frequent gram
    repeated = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated-grams")
    rows = stored(found.join(repeated, "gram", "left_semi"), "repeated-samples")
    name = F.xxhash64("__file", "__row", "place")
    spans = rows.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first"))
    grams = spans.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n_spans"))
    known = stored(spans.join(grams, F.col("gram") == F.col("g")).select(F.col("gram").alias("g"), F.col("span").alias("s"), "n", "first", "n_spans"), "known-spans")
    joined = rows.join(known, (F.col("gram") == F.col("g")) & (F.col("span") == F.col("s")))
    asks = (F.col("n_spans") > 1) & (name == F.col("first"))
    marked = joined.select("__file", "__row", "place", "gram", "n_spans", (F.col("n") > 1).alias("covered"), asks.alias("asks"))
    out = stored(marked.where("covered or asks"), "candidate-samples")
    discard(rows, repeated, known)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))


def remaining(docs: DataFrame, asking: DataFrame) -> DataFrame:
    """The strings of the asking samples: gram, part, file, row, place, covered, distances and names as bytes."""
    wanted = asking.groupBy(F.col("__file").alias("f"), F.col("__row").alias("r")).agg(
        F.collect_list("place").alias("places"), F.collect_list("gram").alias("grams"), F.collect_list("n_spans").alias("n_spans"),
        F.collect_list(F.col("covered").cast("int")).alias("covered"),
    )
    rows = docs.select("__file", "__row", "__text").join(wanted, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r")))
    fields = "gram long, part int, __file long, __row long, place long, covered int, distances binary, names binary"

    def work(batches):
        for batch in batches:
            texts = byte_values(batch.column(2))
            lists = [_lists(batch.column(i)) for i in (3, 4, 5, 6)]
            files, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in blocks(list(map(len, texts))):
                out = [[] for _ in range(8)]
                for i in range(start, stop):
                    _, names = named(texts[i])
                    cut = slice(lists[0][1][i], lists[0][1][i + 1])
                    for place, gram, n_spans, covered in zip(*(values[cut].tolist() for values, _ in lists)):
                        at, far, near = place >> 16, (place >> 8) & 255, place & 255
                        own, distance = names[at - far : at - near + 1], np.arange(far, near - 1, -1, dtype=np.uint8)
                        n_parts = -(-n_spans // SPANS_PER_TASK)
                        part_of = (own >> np.uint64(33)) % np.uint64(n_parts)
                        for part in range(n_parts):
                            mine = part_of == part if n_parts > 1 else slice(None)
                            values = own[mine]
                            if len(values):
                                for column, value in zip(out, (gram, part, files[i], numbers[i], place, covered, distance[mine].tobytes(), values.tobytes())):
                                    column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[f.split()[0] for f in fields.split(", ")])

    return rows.select("__file", "__row", "__text", "places", "grams", "n_spans", "covered").mapInArrow(work, fields)


def merged(strings: DataFrame) -> DataFrame:
    """Spans (file, row, start, stop) of repeated strings: per gram, strings sorted by name and distance."""

    def work(batches):
        for group in grouped(batches, 2):
            covered = np.array(group.column(5).to_pylist())
            if len(covered) < 2 or covered.all():
                continue
            distances = [np.frombuffer(d, np.uint8) for d in group.column(6).to_pylist()]
            names = np.concatenate([np.frombuffer(n, np.uint64) for n in group.column(7).to_pylist()])
            row_of, distance = np.repeat(np.arange(len(covered)), [len(d) for d in distances]), np.concatenate(distances)
            order = np.lexsort((distance, names))
            same = (names[order[1:]] == names[order[:-1]]) & (distance[order[1:]] == distance[order[:-1]])
            twice = np.append(same, False) | np.append(False, same)
            hit = order[twice]
            hit = hit[covered[row_of[hit]] == 0]
            if not len(hit):
                continue
            places = np.array(group.column(4).to_pylist(), np.int64) >> 16
            at = places[row_of[hit]] - distance[hit]
            by = np.lexsort((at, row_of[hit]))
            at, owner = at[by], row_of[hit][by]
            first = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
            last = np.append(first[1:], True)
            rows = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([
                group.column(2).combine_chunks().take(rows), group.column(3).combine_chunks().take(rows), pa.array(at[first]), pa.array(at[last] + LENGTH),
            ], names=["__file", "__row", "start", "stop"])

    return strings.repartition("gram", "part").sortWithinPartitions("gram", "part").mapInArrow(work, "__file long, __row long, start long, stop long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Lists of starts and stops of repeated strings per file and row, for documents that have any."""
    every = stored(sampled(docs), "samples")
    found = candidates(every)
    discard(every)
    asked = stored(merged(remaining(docs, found.where("asks"))), "merged-strings")
    at = F.shiftright("place", 16)
    known = found.where("covered").select(
        "__file", "__row", (at - F.shiftright("place", 8).bitwiseAND(255)).alias("start"), (at - F.col("place").bitwiseAND(255) + LENGTH).alias("stop"),
    )
    spans = known.unionByName(asked).groupBy("__file", "__row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return spans.withColumnsRenamed({"__file": "f", "__row": "r"})


def united(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by ranges."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order]) if len(stops) else stops
    first = np.append(True, starts[1:] > reach[:-1]) if len(starts) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(starts) else first
    return list(zip(starts[first].tolist(), reach[last].tolist()))


def kept_parts(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    edges = [0, *[e for run in runs for e in run], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cut."""
    out = []
    for a, b in runs:
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out += [(a, b)] if a < b else []
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """Identified documents (text in ``__text``) with their lists of starts and stops (null where nothing repeats)."""
    spans = repeated_spans(docs)
    return docs.join(spans, (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r")), "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, removed bytes, removed runs and SHA-256 of the kept bytes of each document."""
    rows = with_spans(identified(docs, F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")))
    rows = rows.select(F.col("__id").alias(id_col), "__text", "starts", "stops")
    schema = T.StructType([rows.schema[id_col], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields])
    target = to_arrow(schema)

    def work(batches):
        for batch in batches:
            texts, starts, stops = byte_values(batch.column(1)), batch.column(2), batch.column(3)
            found = []
            for i, text in enumerate(texts):
                runs = united(starts[i].values.to_numpy(), stops[i].values.to_numpy()) if starts[i].is_valid else []
                found.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_parts(text, runs)).hexdigest()))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), *[pa.array(c, f.type) for c, f in zip(columns, list(target)[1:])]], schema=target)

    return rows.mapInArrow(work, schema)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with repeated strings taken out of their texts, which stay whole characters; null stays null."""
    columns = docs.columns
    rows = identified(docs, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    at = columns.index(text_col)

    def work(batches):
        for batch in batches:
            texts, starts, stops, out = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3), []
            for i, text in enumerate(texts):
                if text is not None and starts[i].is_valid:
                    text = kept_parts(text, whole_characters(text, united(starts[i].values.to_numpy(), stops[i].values.to_numpy())))
                out.append(text)
            arrays = batch.column(0).flatten()
            arrays[at] = pa.array(out, pa.binary()).cast(pa.string()).cast(arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return with_spans(rows).select("__doc", "__text", "starts", "stops").mapInArrow(work, docs.schema)
