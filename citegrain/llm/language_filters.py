"""Operator 1: language identification by language-bitmask n-gram filters.

A bounded sample of labelled texts gives each language its n-grams of several lengths, by document frequency. All
languages share one bit-sliced Bloom filter: a slot is a bitmask of languages, and the bitwise AND of an n-gram's
slots is the set of all languages that contain it. A text's n-grams are looked up once, hits are counted per
language bit, and each count h of n is corrected for the filter's false positives: (h − f·n) / (1 − f), where f is
the rate at which that language's bits answer yes to an unknown n-gram. The largest corrected share decides.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if no language was
learned. Ties go to the language first in code-point order. Repeated rows give repeated results, an empty table
gives no rows, whole texts are read, and columns beside id and text are not read when predicting.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrain.llm.common import mixed, per_text, stored, text_blocks

UNDETERMINED = "und"
GRAM_LENGTHS = (3, 4)
# Bounds of what is learned: labelled documents per language (in expectation), and n-grams per language and length.
SAMPLE_DOCS = 2000
GRAMS_PER_LANGUAGE = 6000
# An n-gram is learned from so many documents on, or from as many as a language's most frequent n-gram reaches.
MIN_DOCUMENTS = 3
# Slots (a power of two) and hash functions of the filter.
SLOTS = 1 << 18
HASHES = 3
# A document is kept if its language leads the next by this share, or has too few n-grams to tell.
MIN_MARGIN = 0.1
MIN_GRAMS = 100
# Text bytes whose n-grams are looked up at once; a character takes some 25 numbers of eight bytes.
GRAM_BLOCK_BYTES = 500_000


@functools.lru_cache(1)
def folds() -> np.ndarray:
    """Per code point its lower-case letter, or a space for what is not a letter."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters and single spaces of texts, and the text each belongs to."""
    decoded = [(t or b"").decode() for t in texts]
    sizes = [len(t) + 2 for t in decoded]
    codes = np.frombuffer("".join(f" {t} " for t in decoded).encode("utf-32-le"), np.uint32)
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    codes = folds()[codes]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (doc_of[1:] != doc_of[:-1])
    codes, doc_of = codes[keep].astype(np.uint64), doc_of[keep]
    size = max(len(codes) - n + 1, 0)
    key = np.zeros(size, np.uint64)
    for step in range(n):
        key = key * np.uint64(0x100000001B3) + codes[step : step + size]
    inside = doc_of[:size] == doc_of[len(doc_of) - size :]
    return mixed(key[inside] + np.uint64(n)), doc_of[:size][inside]


@dataclass
class Filter:
    """Bit-sliced filter: ``slices[w][slot]`` holds the bits of languages 64·w to 64·w+63."""

    languages: list[str]
    slices: np.ndarray
    rates: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The slots of each hash, one array per hash function."""
        return [(mixed(hashes + np.uint64(k)) & np.uint64(self.slices.shape[1] - 1)).astype(np.int64) for k in range(HASHES)]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Per slice and n-gram the bitmask of languages that contain it."""
        first, *rest = self.places(hashes)
        found = self.slices[:, first]
        for place in rest:
            found &= self.slices[:, place]
        return found

    def shares(self, texts: list[bytes | None], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams per text and language, and the number of n-grams of each text."""
        hits = np.zeros((len(self.languages), len(texts)))
        total = np.zeros(len(texts), np.int64)
        for n in lengths:
            hashes, doc_of = grams(texts, n)
            total += np.bincount(doc_of, minlength=len(texts))
            masks = self.contains(hashes)
            for i in range(len(self.languages)):
                hit = masks[i // 64] & (np.uint64(1) << np.uint64(i % 64)) != 0
                hits[i] += np.bincount(doc_of[hit], minlength=len(texts))
        rates = self.rates[:, None]
        share = (hits / np.maximum(total, 1) - rates) / (1 - rates)
        return np.clip(share, 0.0, 1.0), total


def build(languages: list[str], hashes: dict[str, np.ndarray], slots: int = SLOTS) -> Filter:
    """A filter of each language's n-gram hashes, with each language's false-positive rate."""
    made = Filter(languages, np.zeros((max(1, -(-len(languages) // 64)), slots), np.uint64), np.zeros(len(languages)))
    for i, language in enumerate(languages):
        bit = np.uint64(1) << np.uint64(i % 64)
        for place in made.places(hashes[language]):
            made.slices[i // 64][place] |= bit
        filled = ((made.slices[i // 64] & bit) != 0).mean()
        made.rates[i] = min(filled**HASHES, 0.999)
    return made


def learn(
    docs: DataFrame, labelled, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    lengths: tuple[int, ...] = GRAM_LENGTHS, sample_docs: int = SAMPLE_DOCS, grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> Filter:
    """Learn a filter from the rows for which the column ``labelled`` holds and language and text are there.

    About ``sample_docs`` documents of a language are used (all, if it has fewer), those with the smallest hashes of
    id and text, and always the smallest one. A language of which no n-gram is found in ``MIN_DOCUMENTS`` sampled documents
    learns the n-grams found in most of them, so every language whose sample has n-grams is learned. The driver gets three numbers
    per language and at most ``grams_per_language`` n-gram hashes per language and length.
    """
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # a language's number of documents gives the part of the space of hashes that holds its sample
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()
    if not sizes:
        return build([], {})
    last = {r["lang"]: 2**63 - 1 if r["n"] <= sample_docs else max(r["least"], int(sample_docs / r["n"] * 2**64) - 2**63) for r in sizes}
    sample = rows.where(F.col("h") <= by_language(last)).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, stop, texts in text_blocks(batch.column(1), GRAM_BLOCK_BYTES):
                parts = []
                for n in lengths:
                    found, doc_of = grams(texts, n)
                    pairs = np.unique(np.stack([found, doc_of.astype(np.uint64)]), axis=1)
                    names, codes = np.unique(np.array(langs[start:stop], object), return_inverse=True)
                    lang_of = codes[pairs[1].astype(np.int64)]
                    for i, name in enumerate(names):
                        seen, times = np.unique(pairs[0][lang_of == i], return_counts=True)
                        parts.append((name, n, seen, times))
                for name, n, seen, times in parts:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(seen), pa.string()), pa.array([n] * len(seen), pa.int32()),
                        pa.array(seen.view(np.int64)), pa.array(times.astype(np.int64)),
                    ], names=["lang", "n", "gram", "docs"])

    counted = sample.mapInArrow(count, "lang string, n int, gram long, docs long").groupBy("lang", "n", "gram").agg(F.sum("docs").alias("docs"))
    counted = stored(counted, "language-grams")
    bounds = {r["lang"]: min(MIN_DOCUMENTS, r["most"]) for r in counted.groupBy("lang").agg(F.max("docs").alias("most")).collect()}
    if not bounds:
        return build([], {})
    best = Window.partitionBy("lang", "n").orderBy(F.desc("docs"), "gram")
    top = counted.where(F.col("docs") >= by_language(bounds)).withColumn("r", F.row_number().over(best))
    chosen = top.where(F.col("r") <= grams_per_language).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    hashes = {row["lang"]: np.array(row["grams"], np.int64).view(np.uint64) for row in chosen}
    return build(sorted(hashes), hashes)


def by_language(numbers: dict[str, int]) -> Column:
    """The number of each row's language."""
    return F.element_at(F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for pair in numbers.items() for x in pair]), F.col("lang"))


def predict(
    docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = GRAM_LENGTHS,
) -> DataFrame:
    """Language and score of each document; the score is the winner's corrected share of n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        return verdicts(shared.value, texts, lengths)

    return per_text(docs, id_col, text_col, "lang_pred string, score double, margin double, n_grams long", compute, GRAM_BLOCK_BYTES)


def verdicts(model: Filter, texts: list[bytes | None], lengths: tuple[int, ...] = GRAM_LENGTHS) -> dict[str, object]:
    """Language, score and lead over the next language of a block of texts."""
    blank = {"lang_pred": [UNDETERMINED] * len(texts)} | {k: np.zeros(len(texts), t) for k, t in (("score", float), ("margin", float), ("n_grams", int))}
    if not model.languages:
        return blank
    share, total = model.shares(texts, lengths)
    best = share.argmax(axis=0)
    ranked = np.sort(share, axis=0)
    score = ranked[-1]
    second = ranked[-2] if len(ranked) > 1 else np.zeros_like(score)
    letters = np.array([has_letters(t) for t in texts], bool)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters)]
    return {
        "lang_pred": names, "score": np.where(letters, score, 0.0), "margin": np.where(letters, score - second, 0.0), "n_grams": total,
    }


def has_letters(text: bytes | None) -> bool:
    """Whether a text has a letter; the first one ends the search."""
    return any(map(str.isalpha, text.decode())) if text else False


def kept(
    docs: DataFrame, model: Filter, min_margin: float = MIN_MARGIN, min_grams: int = MIN_GRAMS, text_col: str = "text",
    lengths: tuple[int, ...] = GRAM_LENGTHS,
) -> DataFrame:
    """The documents in one language, all columns as they came.

    Rejected are undetermined documents and those of ``min_grams`` n-grams or more in which no language leads the
    next one by ``min_margin``: mixtures. Shorter texts need not lead, as few n-grams may belong to several languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            stays = []
            for _, _, texts in text_blocks(batch.column(at), GRAM_BLOCK_BYTES):
                found = verdicts(shared.value, texts, lengths)
                clear = (found["margin"] >= min_margin) | (found["n_grams"] < min_grams)
                stays.append((np.array(found["lang_pred"]) != UNDETERMINED) & clear)
            yield batch.filter(pa.array(np.concatenate(stays) if stays else np.zeros(0, bool)))

    return docs.mapInArrow(work, docs.schema)
