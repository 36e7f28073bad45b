"""How much of one text consists of passages of another, and the distance that follows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the shortest passage that counts as copied.
PASSAGE = 16
#: Characters of a text that are worked on at once; the memory of a comparison follows from it.
SLICE = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def rolling_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` characters."""
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(text)), out=sums[1:])
    return (sums[size:] - sums[:-size]) * _powers(_INVERSE, len(text) - size + 1)


def _known_runs(text: np.ndarray, source: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` characters of ``text`` whether ``source`` holds it: looked up by
    hash, confirmed by its characters."""
    own, theirs = rolling_hashes(text, size), rolling_hashes(source, size)
    order = np.argsort(theirs, kind="stable")
    ordered = theirs[order]
    place = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
    found = np.flatnonzero(ordered[place] == own)
    there = order[place[found]]
    same = np.ones(len(found), bool)
    for k in range(size):
        same &= text[found + k] == source[there + k]
    known = np.zeros(len(own), bool)
    known[found[same]] = True
    return known


def _slices(text: np.ndarray, size: int, limit: int):
    """Slices that overlap so that every run of ``size`` characters lies whole in exactly one."""
    for start in range(0, len(text) - size + 1, limit):
        yield start, text[start : start + limit + size - 1]


def copied_characters(text: np.ndarray, source: np.ndarray, size: int = PASSAGE, limit: int = SLICE) -> int:
    """Characters of ``text`` that lie in a passage of ``size`` or more characters ``source`` holds too.

    Every run of ``size`` characters is looked up; runs that overlap make up the whole passage, so
    passages are found at any place and length. Both texts are taken slice by slice.
    """
    if min(len(text), len(source)) < size:
        return 0
    starts = []
    for first, part in _slices(text, size, limit):
        known = np.zeros(len(part) - size + 1, bool)
        for _, other in _slices(source, size, limit):
            known |= _known_runs(part, other, size)
        starts.append(first + np.flatnonzero(known))
    begins = np.concatenate(starts)
    return int(np.minimum(np.diff(begins), size).sum()) + size if len(begins) else 0


def copy_distance(left: str, right: str, size: int = PASSAGE) -> float:
    """The larger number of characters that one text does not have from the other, over the longer length."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (left, right))
    if not len(a) and not len(b):
        return 0.0
    alone = max(len(a) - copied_characters(a, b, size), len(b) - copied_characters(b, a, size))
    return alone / max(len(a), len(b))


@F.pandas_udf(T.DoubleType())
def copy_distance_udf(left: pd.Series, right: pd.Series, size: pd.Series) -> pd.Series:
    found = [copy_distance(a, b, int(n)) for a, b, n in zip(left, right, size)]
    return pd.Series(found, dtype="float64")
