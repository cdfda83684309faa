"""Operator 8: token ids in directly addressable codes.

A segment holds the ids of consecutive documents. Each id is cut into chunks of eight bits, the lowest first; level k
holds the k-th chunk of every id that has one, with a continuation bitmap saying which ids go on at the next level and
a rank directory with the number of set bits before every 512th. The id at any position is found by following ranks,
so a document's tokens, or any one token, are read without decoding what is before them.

Layout of a segment (little-endian): magic ``DAC1``, uint64 number of ids, uint32 number of levels; then per level
uint64 number of chunks, the chunks, the bitmap of ceil(n/8) bytes and ceil(n/512) directory entries of uint64.

Segments are rows of a table that Spark writes and commits, one file per range of document ids, so that a lost
executor costs a retry of its tasks only and any store that Spark writes to will do.

Defined results: a null or empty text has no ids but its end id; rows with equal ids stand in the order of the
hashes of their texts, null ids come first; an empty table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from citegrain.llm.common import Numbers, blocks, byte_values, gather, stored, to_arrow

MAGIC = b"DAC1"
DIRECTORY_BITS = 512
SEGMENT_TOKENS = 1 << 17
MEMORY_WORDS = 1_000_000
TAIL = ".,;:!?"
TAIL_BYTES = TAIL.encode()
# Stems that the library gets as one text.
JOINED = 2000
# Letters below are Latin ones that normalisation keeps as single letters.
FIRST_UNSAFE = "\u0250"
PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01ba\u01c0-\u024f]+")


def pack(ids: np.ndarray) -> bytes:
    """A segment of non-negative ids."""
    rest, levels = np.asarray(ids, np.uint64), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), DIRECTORY_BITS)) if len(more) else np.zeros(0, np.uint64)
        before = (np.cumsum(ones) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint64(255)).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> np.uint64(8)
        if not len(rest):
            return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Reader:
    """Random access to the ids of a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.size, n_levels = struct.unpack_from("<QI", data, 4)
        at, self.levels = 16, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            n_bits, n_entries = -(-n // 8), -(-n // DIRECTORY_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, n_bits, at + 8 + n)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u8", n_entries, at + 8 + n + n_bits)))
            at += 8 + n + n_bits + 8 * n_entries

    def rank(self, level: int, position: int) -> int:
        """Set continuation bits before a position of a level: a directory entry and the bits of one block."""
        chunks, bits, directory = self.levels[level]
        if position >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = position // DIRECTORY_BITS
        whole = bits[block * DIRECTORY_BITS // 8 : position // 8]
        part = int(bits[position // 8]) & ((1 << (position % 8)) - 1)
        return int(directory[block]) + int.from_bytes(whole.tobytes(), "little").bit_count() + part.bit_count()

    def __getitem__(self, position: int) -> int:
        """One id."""
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[position]) << (8 * level)
            if not int(bits[position // 8]) >> (position % 8) & 1:
                return value
            position, level = self.rank(level, position), level + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: per level one rank and the chunks of the range."""
        out = np.zeros(max(stop - start, 0), np.uint32)
        places = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            found = chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            if places is None:
                out |= found
            else:
                out[places] |= found
            first = start // 8
            more = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            places = np.flatnonzero(more) if places is None else places[more]
            start = self.rank(level, start)
            stop = start + len(places)
        return out


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never span white space.

    Each distinct word goes through the library once per worker; closing punctuation after letters and the case of
    ASCII letters are taken off first, as the tokenizer itself splits the one and folds the other. Stems of letters
    alone go as one text of many: each ends with one token that ends a word, so the ids are cut there. Words with a
    mark of the tokenizer's special tokens go to the library as they are.
    """

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.marks = [token.content.lower().encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.parts: dict[bytes, int] = {}
        self.part_ids, self.part_counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.word_ids, self.word_counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _cut(self, word: bytes, marked: bool) -> tuple[bytes, bytes]:
        """A word's stem and closing punctuation; all of it is the stem where the two may not be told apart."""
        if marked and any(mark in word.lower() for mark in self.marks):
            return word, b""
        if word.isascii():
            word = word.lower()
        stem = word.rstrip(TAIL_BYTES)
        last = stem.decode()[-1:]
        return (stem, word[len(stem) :]) if last.isalpha() and last < FIRST_UNSAFE and len(last.lower()) == 1 else (word, b"")

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems of plain letters, one after the other, and the number of each one's ids."""
        texts = [b" ".join(stems[i : i + JOINED]).decode() for i in range(0, len(stems), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._library(texts)), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(stems):
            return ids, np.diff(last, prepend=-1)
        return self._others(stems)

    def _others(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_stems``, for any parts."""
        found = self._library([part.decode() for part in parts])
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, fresh: list[bytes]) -> None:
        """Take words into the memory, in the order of their numbers."""
        lower = b" ".join(fresh).lower()
        marked = any(mark in lower for mark in self.marks)
        stems = [word.rstrip(TAIL_BYTES) for word in lower.split()]
        tails = [word[len(stem) :] for word, stem in zip(fresh, stems)]
        for i in [i for i, plain in enumerate(map(bytes.isalpha, stems)) if not plain]:
            stems[i], tails[i] = self._cut(fresh[i], marked)
        new = [part for part in dict.fromkeys(chain(stems, tails)) if part not in self.parts]
        # letters below the bound, but for the one that is two characters in lower case, are letters to the library too
        letters = [part.isalpha() or bool(PLAIN.fullmatch(part.decode())) for part in new]
        for parts, encode in (([p for p, ok in zip(new, letters) if ok], self._stems), ([p for p, ok in zip(new, letters) if not ok], self._others)):
            ids, counts = encode(parts) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts))))
            self.part_ids, self.part_counts = np.append(self.part_ids, ids), np.append(self.part_counts, counts)
        numbers = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(zip(stems, tails))), np.int64, 2 * len(stems))
        self.word_ids = np.append(self.word_ids, gather(self.part_ids, self.part_counts, numbers))
        self.word_counts = np.append(self.word_counts, self.part_counts[numbers].reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, without special tokens."""
        if len(self.known) > self.memory:
            self._forget()
        known = self.known
        old = len(known)
        split = []
        for text in texts:
            words = text.split()
            split.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if len(known) > old:
            self._learn(list(islice(known, old, None)))
        starts = np.cumsum(self.word_counts) - self.word_counts
        return [gather(self.word_ids, self.word_counts, numbers, starts) for numbers in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_segments(
    docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Segments of all documents in ascending order of ids, as a stored table.

    Documents are dealt by ranges of the id and sorted within a range. A segment holds whole documents and is closed
    at ``segment_tokens`` ids; ``part`` counts the ranges, ``part_start`` the ids before the segment in its range.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("docs", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("dac", T.BinaryType()),
    ])
    target = to_arrow(schema)

    def work(batches):
        tool, part = encoder(path), TaskContext.get().partitionId()
        before, size, names, counts, ids = 0, 0, [], [], []

        def close():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.array([names], target.field(3).type), pa.array([counts], target.field(4).type), pa.array([pack(flat)], pa.binary()),
            ], schema=target)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), byte_values(batch.column(1))
            for start, stop in blocks(list(map(len, texts))):
                for key, found in zip(keys[start:stop], tool.encode(texts[start:stop])):
                    names.append(key)
                    ids.append(np.append(found, np.uint32(end_id)))
                    counts.append(len(ids[-1]))
                    size += counts[-1]
                    if size >= segment_tokens:
                        yield close()
                        before, size, names, counts, ids = before + size, 0, [], [], []
        if names:
            yield close()

    text = F.col(text_col).cast("string")
    ordered = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    # rows of one id, or without one, may be many: ranges divide them by the hash of their text
    ordered = ordered.repartitionByRange("__id", "__hash").sortWithinPartitions("__id", "__hash", "__text").drop("__hash")
    return stored(ordered.mapInArrow(work, schema), "token-segments")


def read_documents(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents from stored segments: id, start, n_tokens and CRC-32 of the ids as little-endian 32-bit integers.

    One number per range of ids goes through the driver: how many ids its segments hold.
    """
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, offsets = 0, {}
    for part in sorted(totals):
        offsets[part], first = first, first + totals[part]
    schema = T.StructType([
        T.StructField(id_col, segments.schema["docs"].dataType.elementType), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    target = to_arrow(schema)

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, part_start, names, counts, data = (batch.column(i)[row] for i in range(5))
                reader, counts = Reader(data.as_py()), counts.values.to_numpy()
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(reader.slice(e - n, e).astype("<u4").tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                starts = ends - counts + offsets[part.as_py()] + part_start.as_py()
                yield pa.RecordBatch.from_arrays(
                    [names.values.cast(target.field(0).type), pa.array(starts), pa.array(counts), pa.array(crcs, pa.int64())], schema=target,
                )

    return segments.select("part", "part_start", "docs", "counts", "dac").mapInArrow(work, schema)
