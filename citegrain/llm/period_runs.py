"""Operator 12: periodic runs of words.

A diagonal is a lag between equal words. Reading on, each word that equals the word one lag before lengthens the match
of that diagonal; where the match ends, the diagonal emits a run if it is long enough, that is lag + matches >= 4 lags
and six words. Diagonals are kept sparse without losing a run: a run of lag q has 3q matches or more, so among lags
from x up to 1.5x only diagonals with 3x matches matter, and a word's earlier occurrences are those of the 3x words that
start with it. Two such lags at one word sum to less than 3x, hence the words repeat at a common divisor of both, so
only the nearest occurrence can have the lag as its smallest period: each word adds to one diagonal per band of lags,
about log(n) in all, even in a text of one word repeated. Names of 3x words are exact (pairs of names of half the
length), and positions whose words occur once drop out before the next doubling. A block of texts is handled at once.

Defined results: a null or blank text has no words and no runs; repeated rows give repeated results; an empty table
gives no rows; whole texts are read whatever their length, in memory proportional to a block or one longer text;
columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from citegrain.llm.common import Numbers, per_text

MIN_LENGTH = 6
MIN_REPEATS = 4
# Words that a band's diagonals match at least, per word of its smallest lag.
MATCHED = MIN_REPEATS - 1


class Grams:
    """Names of the strings of ``length`` words that occur twice or more in one text, by where they start."""

    def __init__(self, length: int, at: np.ndarray, key: np.ndarray, doc_of: np.ndarray):
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        # the nearest earlier occurrence in the same text
        near = np.zeros(len(key), bool)
        near[1:] = ~new[1:] & (doc_of[place[1:]] == doc_of[place[:-1]])
        alive = near.copy()
        alive[:-1] |= near[1:]
        self.length, self.names = length, np.full(len(doc_of), -1, np.int64)
        self.names[place[alive]] = np.cumsum(new)[alive]
        self.lags = np.zeros(len(doc_of), np.int64)
        back = np.flatnonzero(near)
        self.lags[place[back]] = place[back] - place[back - 1]

    def longer(self, length: int, doc_of: np.ndarray) -> Grams:
        """Grams of a length up to twice this one: two of this length, one at the start and one at the end."""
        step = length - self.length
        at = np.flatnonzero(self.names[: max(len(doc_of) - step, 0)] >= 0)
        at = at[(self.names[at + step] >= 0) & (doc_of[at] == doc_of[at + step])]
        return Grams(length, at, self.names[at] * (len(doc_of) + 1) + self.names[at + step], doc_of)

    @property
    def empty(self) -> bool:
        return not (self.names >= 0).any()


def first_grams(words: np.ndarray, doc_of: np.ndarray) -> Grams:
    """Grams of three words."""
    at = np.flatnonzero(doc_of[:-2] == doc_of[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    base = int(words.max()) + 1 if len(words) else 1
    pair = words[at] * base + words[at + 1]
    if base**3 >= 2**63:
        pair = np.unique(pair, return_inverse=True)[1]
    return Grams(MATCHED, at, pair * base + words[at + 2], doc_of)


def find_runs(words: np.ndarray, doc_of: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of each run in word numbers of several texts one after the other."""
    found = [np.zeros((3, 0), np.int64)]
    grams, lag = first_grams(words, doc_of), 1
    while MIN_REPEATS * lag <= longest and not grams.empty:
        next_lag = max(lag + 1, -(-3 * lag // 2))
        length = MATCHED * lag
        while 2 * grams.length <= length:
            grams = grams.longer(2 * grams.length, doc_of)
        band = grams if grams.length == length else grams.longer(length, doc_of)
        at = np.flatnonzero((band.lags >= lag) & (band.lags < next_lag))
        if len(at):
            lags = band.lags[at]
            ends = np.append(np.flatnonzero((at[1:] != at[:-1] + 1) | (lags[1:] != lags[:-1])), len(at) - 1)
            starts = np.append(0, ends[:-1] + 1)
            period = lags[ends]
            start, end = at[starts] - period, at[ends] + length
            ok = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
            # a diagonal that matches on beyond its grams' nearest occurrences has a smaller period
            before, after = np.maximum(start - 1, 0), np.minimum(end, len(words) - 1)
            ok &= ~((start > 0) & (doc_of[before] == doc_of[start]) & (words[before] == words[before + period]))
            ok &= ~((end < len(words)) & (doc_of[after] == doc_of[start]) & (words[after] == words[after - period]))
            found.append(np.stack([start[ok], end[ok], period[ok]]))
        lag = next_lag
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of_texts(texts: list[bytes | None]) -> dict[str, object]:
    """Number of words, runs and collapsed text of each text of a block."""
    split = [(text or b"").split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    first = np.cumsum(sizes) - sizes
    known = Numbers()
    words = np.fromiter((known[w] for part in split for w in part), np.int64, int(sizes.sum()))
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = find_runs(words, doc_of, int(sizes.max(initial=0)))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    kept = np.cumsum(edges[:-1]) == 0
    runs: list[list[dict]] = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        doc = int(doc_of[s])
        runs[doc].append({"start": s - int(first[doc]), "length": e - s, "period": q})
    collapsed = []
    for doc, part in enumerate(split):
        if runs[doc]:
            part = [w for w, stays in zip(part, kept[first[doc] : first[doc] + len(part)].tolist()) if stays]
        collapsed.append(b" ".join(part).decode())
    return {"n_words": sizes, "runs": runs, "collapsed": collapsed}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, runs (by start, then period) and collapsed text of each document.

    The collapsed text holds the words that no run contains after its first period, joined by single spaces.
    """
    schema = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return per_text(docs, id_col, text_col, schema, runs_of_texts)


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first one of equal ones, null without runs."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def with_periodic_tail(docs: DataFrame, chosen: Column, start: Callable[[Column], Column], period: Callable[[Column, Column], Column], text_col: str = "text") -> DataFrame:
    """Chosen texts with all words from word a on replaced by repeats of the p words there: a text set for the operator.

    ``start`` gives a from the number of words, ``period`` gives p from that number and a. Blank texts stay.
    """
    words = F.when(chosen, F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    out = docs.withColumn("__words", words).withColumn("__n", F.size("__words"))
    out = out.withColumn("__a", F.when(F.col("__n") > 0, start(F.col("__n")))).withColumn("__p", period(F.col("__n"), F.col("__a")))
    left = F.col("__n") - F.col("__a")
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("__p")).cast("int"))), F.lit(1), left)
    rewritten = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    changed = F.when(F.col("__a").isNotNull(), rewritten).otherwise(F.col(text_col))
    return out.withColumn(text_col, changed).drop("__words", "__n", "__a", "__p")
