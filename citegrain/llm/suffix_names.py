"""Numpy part of the suffix operator: names of byte strings at every position, and the sampled positions."""

from __future__ import annotations

import numpy as np

from citegrain.llm.common import mixed

LENGTH = 200
# Lengths that the names of the levels stand for: words of 8 bytes, triples of words, triples of those, the whole.
WORD, TRIPLE, GRAM = 8, 24, 72
# Distances of the three names that a name of the next level is made of; the last triple overlaps to fit LENGTH.
STEPS = (8, 24, 64)
WINDOW = LENGTH - GRAM + 1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def triples(names: np.ndarray, step: int) -> np.ndarray:
    """Names of the triples (i, i + step, i + 2·step)."""
    size = len(names) - 2 * step
    if size <= 0:
        return np.zeros(0, np.uint64)
    x = names[:size] * _A
    x ^= x >> np.uint64(32)
    x += names[step : step + size]
    x *= _B
    x ^= x >> np.uint64(29)
    x += names[2 * step : 2 * step + size]
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def named(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 72-byte grams and of the 200-byte strings at every position of a text of 200 bytes or more."""
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WORD)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    grams = triples(triples(words, STEPS[0]), STEPS[1])
    return grams, triples(grams, STEPS[2])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Per window of ``width`` values the position of the smallest; of equal ones the last."""
    last = np.uint64(0xFFFFFFFF)
    packed = (values & ~last) | (last - np.arange(len(values), dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    rest = width - span
    if rest:
        packed = np.minimum(packed[:-rest], packed[rest:])
    return (last - (packed & last)).astype(np.int64)


def samples(data: bytes) -> dict[str, np.ndarray]:
    """The sampled positions of a text and the 200-byte strings that each stands for.

    A string at p belongs to the smallest gram name in it, at ``at``; strings ``low`` to ``high`` belong to one
    sample. Equal strings have equal samples at equal distances, wherever they are: a cover of all differences.
    ``gram`` is the name at the sample; ``span`` names all bytes of its strings and their distances.
    """
    grams, strings = named(data)
    owner = window_minima(grams, WINDOW)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner)) - 1
    at = owner[first]
    near, far = (at - last).astype(np.uint64), (at - first).astype(np.uint64)
    span = mixed(mixed(strings[first] + far * _A) + strings[last] * _B + near)
    return {"at": at, "low": first, "high": last, "gram": grams[at], "span": span}
