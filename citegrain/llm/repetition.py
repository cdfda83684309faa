"""Operator 7: quality rules by repetition coverage.

Words become numbers, rolling (Horner) hashes of several n-gram lengths run over the numbers in numpy, and every
word inside an n-gram that the same text holds twice is covered. Coverage is measured in characters. A block of
documents is hashed at once; a document's number salts its hashes, so documents never match each other.

Defined results: a null or blank text has zero words and fails the base rules; repeated rows give repeated results;
an empty table gives no rows; texts are read whole whatever their length; columns beside id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from citegrain.llm.common import mixed, per_text

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
BASE_N = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Largest share of word characters inside duplicated n-grams, by length, and inside repeated lines.
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_COVERAGE = 0.20

_SALT = np.uint64(1 << 60)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def n_chars(data: bytes) -> int:
    """Code points outside white space in UTF-8."""
    return len(data.translate(None, WHITE + CONTINUATION))


def covered_words(numbers: np.ndarray, doc_of: np.ndarray, n: int) -> np.ndarray:
    """Flags the words inside an n-gram that occurs twice or more in their document.

    ``numbers`` are mixed word numbers of several documents one after the other, ``doc_of`` the documents' numbers.
    """
    size = len(numbers) - n + 1
    if size <= 0:
        return np.zeros(len(numbers), bool)
    with np.errstate(over="ignore"):
        rolling = numbers[:size].copy()
        for step in range(1, n):
            rolling = rolling * _FACTOR + numbers[step : step + size]
        # the salt must differ from any word's number, or a word and a salt could stand in for each other
        rolling = mixed(rolling ^ mixed(doc_of[:size].astype(np.uint64) + _SALT))
    starts = np.flatnonzero(doc_of[:size] == doc_of[n - 1 :])
    order = starts[np.argsort(rolling[starts], kind="stable")]
    same = rolling[order[1:]] == rolling[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(numbers) + 1, np.int32)
    edges[order[twice]] += 1
    edges[order[twice] + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def measures(texts: list[bytes | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of a block of texts and, per n-gram length, covered words and characters."""
    size = len(texts)
    out = {k: np.zeros(size, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars")}
    ids, chars, docs = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        seen: dict[bytes, int] = {}
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words)))
        length = np.fromiter(map(n_chars, seen), np.int64, len(seen))
        chars.append(length[ids[-1].astype(np.int64)])
        docs.append(np.full(len(words), i, np.int64))
        out["n_words"][i] = len(words)
        out["word_chars"][i] = chars[-1].sum()
        out["n_symbols"][i] = len(text) - len(text.translate(None, SYMBOLS))
        lines: set[bytes] = set()
        for line in text.split(b"\n"):
            if line.strip():
                if line in lines:
                    out["n_dup_lines"][i] += 1
                    out["dup_line_chars"][i] += n_chars(line)
                lines.add(line)
    with np.errstate(over="ignore"):
        numbers = mixed(np.concatenate(ids) + np.uint64(1)) if ids else np.zeros(0, np.uint64)
    length = np.concatenate(chars) if chars else np.zeros(0, np.int64)
    doc_of = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    for n in sorted(set(lengths)):
        hit = covered_words(numbers, doc_of, n)
        out[f"words_{n}"] = np.bincount(doc_of[hit], minlength=size)
        out[f"chars_{n}"] = np.bincount(doc_of[hit], weights=length[hit], minlength=size).astype(np.int64)
    return out


def repetition(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_coverage: dict[int, float] | None = None, max_line_coverage: float = MAX_LINE_COVERAGE,
) -> DataFrame:
    """Counts, base verdict, coverage per n-gram length and the verdict on each document."""
    limits = dict(sorted((MAX_COVERAGE if max_coverage is None else max_coverage).items()))

    def compute(texts):
        m = measures(texts, (*limits, BASE_N))
        total = np.maximum(m["word_chars"], 1)
        out = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
        out["n_repeat_words"] = m[f"words_{BASE_N}"]
        out["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        out["dup_line_share"] = m["dup_line_chars"] / total
        bad = out["base_failed"] | (out["dup_line_share"] > max_line_coverage)
        for n, limit in limits.items():
            out[f"dup_{n}_share"] = m[f"chars_{n}"] / total
            bad |= out[f"dup_{n}_share"] > limit
        return out | {"kept": ~bad}

    schema = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
        "dup_line_share double" + "".join(f", dup_{n}_share double" for n in limits)
    )
    return per_text(docs, id_col, text_col, schema, compute)
