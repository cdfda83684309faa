"""Operator 9: byte-level BPE encoding and decoding by corpus-level merge replay.

A task gathers the pieces (matches of the split pattern) of its documents' new distinct chunks into one flat array
of ids with links to the neighbours. An inverted index maps each token pair that the vocabulary can merge to the positions
that hold it. The pairs are replayed in rank order over all pieces at once; a merge touches only its two neighbours,
whose new pairs enter the index. Distinct chunks are encoded once per worker and looked up from then on; the memory
of known chunks is bounded and starts anew when full, which changes no result.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results; an
empty table gives no rows; texts of any length are taken whole; columns beside id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from citegrain.llm.common import Numbers, blocks, gather, per_text, to_arrow

MEMORY_CHUNKS = 300_000
CORPUS_BYTES = 4_000_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank; ranks must be 0, 1, 2, …"""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tokens by rank, and the rank of each mergeable pair of tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = len(tokens)
        rank = {token: i for i, token in enumerate(tokens)}
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.lengths = lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, ``size`` where there is none; a negative id never merges."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        ok = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_ranks[at], self.size)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        shift = np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[np.arange(ends[-1]) + shift].tobytes()


def replay(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' ids one after the other, and how many each piece has.

    Every merge is applied in rank order over all pieces at once, by an inverted index of pairs.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64), sizes
    none = vocabulary.size
    piece_of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    # one slot more at the end stands for "no neighbour"
    token = np.append(vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], -1).astype(np.int32)
    after = np.arange(1, total + 2, dtype=np.int32)
    after[total] = total
    after[:total][np.append(piece_of[1:] != piece_of[:-1], True)] = total
    before = np.full(total + 1, total)
    linked = np.flatnonzero(after[:total] != total)
    before[after[linked]] = linked
    before[total] = total

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Add the pairs that start at these places to the inverted index."""
        ranks = vocabulary.ranks_of(token[places], token[after[places]])
        keep = ranks < none
        places, ranks = places[keep], ranks[keep]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, start, stop in zip(ranks[starts].tolist(), starts, [*starts[1:], len(places)]):
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(places[start:stop])

    enter(linked)
    while heap:
        rank = heapq.heappop(heap)
        places = np.sort(np.concatenate(index.pop(rank)))
        # an entry may be there twice, and is stale if its token or its neighbour has been merged meanwhile
        places = places[np.append(True, places[1:] != places[:-1])]
        places = places[vocabulary.ranks_of(token[places], token[after[places]]) == rank]
        if not len(places):
            continue
        right = after[places]
        # of overlapping places (x x x) every second one counts, from the left of each chain
        chained = np.append(False, (right[:-1] == places[1:]))
        if chained.any():
            at = np.arange(len(places))
            head = np.maximum.accumulate(np.where(chained, 0, at))
            taken = (at - head) % 2 == 0
        else:
            taken = np.ones(len(places), bool)
        places = places[taken]
        right = after[places]
        several = np.append(piece_of[places[1:]] == piece_of[places[:-1]], False)
        if several.any():
            # where a merge would give an earlier pair, only the leftmost place of the piece is merged now
            merged_prev = np.append(False, after[right[:-1]] == places[1:])
            left_now = np.where(merged_prev, rank, token[before[places]])
            early = vocabulary.ranks_of(left_now, np.full(len(places), rank)) < rank
            early |= vocabulary.ranks_of(token[before[places]], np.full(len(places), rank)) < rank
            early |= vocabulary.ranks_of(np.full(len(places), rank), token[after[right]]) < rank
            bad = np.unique(piece_of[places[early]])
            first = np.append(True, piece_of[places[1:]] != piece_of[places[:-1]])
            later = np.isin(piece_of[places], bad) & ~first
            if later.any():
                index[rank] = [places[later]]
                heapq.heappush(heap, rank)
                places = places[~later]
                right = after[places]
        beyond = after[right]
        token[places] = rank
        token[right] = -1
        after[places] = beyond
        inner = beyond != total
        before[beyond[inner]] = places[inner]
        after[right] = total
        touched = np.concatenate([places, before[places]])
        enter(touched[touched != total])
    alive = token[:total] >= 0
    return token[:total][alive], np.bincount(piece_of[alive], minlength=len(pieces))


class Encoder:
    """Splits texts and encodes them; remembers the chunks it has met.

    A chunk is a run without spaces and the one space before it. No match of ``pattern`` may run from a character
    over a single space to the next one; then matches never cross chunks whose ends are not white space, and each
    distinct chunk is split by the pattern only once. Texts with other chunks are split by the pattern as a whole.
    """

    MARK = "\x1e"

    def __init__(self, path: str, pattern: str, memory: int = MEMORY_CHUNKS):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.uneven = np.zeros(0, bool)

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.memory:
            self._forget()
        old = len(self.known)
        split = [
            self._numbers(t.replace(" ", self.MARK + " ").split(self.MARK) if self.MARK not in t else self.pattern.findall(t))
            for t in texts
        ]
        uneven = [c[-1:].isspace() or c[:2].isspace() or not c for c in islice(self.known, old, None)]
        self.uneven = np.concatenate([self.uneven, np.array(uneven, bool)])
        for i, numbers in enumerate(split):
            if self.uneven[numbers].any():
                split[i] = self._numbers(self.pattern.findall(texts[i]))
        self.uneven = np.concatenate([self.uneven, np.zeros(len(self.known) - len(self.uneven), bool)])
        pieces = [self.pattern.findall(c) for c in islice(self.known, old, None)]
        ids, counts = replay(self.vocabulary, [p.encode() for found in pieces for p in found])
        chunk_of = np.repeat(np.arange(len(pieces)), [len(found) for found in pieces])
        counts = np.bincount(chunk_of, weights=counts, minlength=len(pieces)).astype(np.int64)
        self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        return [gather(self.ids, self.counts, numbers, starts) for numbers in split]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a rank file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each document: the id column and ``ids`` (array of int)."""
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([narrow.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    target = to_arrow(schema)

    def work(batches):
        tool = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in blocks(list(map(len, texts)), CORPUS_BYTES):
                found = tool.encode(texts[start:stop])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start).cast(target.field(0).type), pa.ListArray.from_arrays(offsets, pa.array(flat)).cast(target.field(1).type)],
                    schema=target,
                )

    return narrow.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of each id sequence: the id column, the ids as little-endian 32-bit integers, and the decoded bytes."""
    narrow = encoded.select(F.col(id_col), F.col(ids_col).alias("__ids"))
    schema = T.StructType([
        narrow.schema[id_col], T.StructField("n_tokens", T.LongType()),
        T.StructField("id_bytes", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
    ])
    target = to_arrow(schema)

    def work(batches):
        tool = decoder(path)
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(target.field(0).type), pa.array([len(p) for p in parts], pa.int64()),
                pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
                pa.array([tool.decode(p.astype(np.int64)) for p in parts], pa.binary()),
            ], schema=target)

    return narrow.mapInArrow(work, schema)


_decoders: dict[str, Vocabulary] = {}


def decoder(path: str) -> Vocabulary:
    """The worker's vocabulary of a rank file."""
    if path not in _decoders:
        _decoders[path] = Vocabulary(read_ranks(path))
    return _decoders[path]


def round_trip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Number of ids of each document, SHA-256 of the ids and of the bytes decoded from them, and the ids if asked for.

    One worker encodes a text and decodes the ids, so that these need not travel.
    """

    def compute(texts):
        tool = encoder(path, pattern)
        ids = tool.encode([(t or b"").decode() for t in texts])
        out = {
            "n_tokens": [len(found) for found in ids], "ids_sha256": list(map(ids_digest, ids)),
            "decoded_sha256": [hashlib.sha256(tool.vocabulary.decode(found.astype(np.int64))).hexdigest() for found in ids],
        }
        return out | ({"ids": [found.astype(np.int32) for found in ids]} if with_ids else {})

    return per_text(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, compute)


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return hashlib.sha256(np.asarray(ids).astype("<u4").tobytes()).hexdigest()
