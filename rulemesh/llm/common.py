"""What the corpus operators share: table access, text batches as bytes, word hashes.

Everything below ``text_slices`` works inside a task on one slice of an Arrow
batch. A slice holds whole texts only and about ``SLICE_BYTES`` of them (a single
longer text is a slice of its own), which bounds the working memory of a task
whatever the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.session import ship_package

SLICE_BYTES = 1 << 19
# Broadcasts stay below this many bytes, measured before.
BROADCAST_BYTES = 16 << 20
# A word is a run of other bytes than these.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
# Words of a shingle, and the share two near duplicates have in common.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75

_WORD = np.ones(256, dtype=bool)
_WORD[list(SPACES)] = False
# Letters and digits only; bytes of longer characters count as letters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, pow(_BASE, -1, 1 << 64))
KEPT_POWERS = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder that puts a document into a fold: crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(0))


def sample_share(rows: int, bound: int) -> Column:
    """Whether a document belongs to a sample of about ``bound`` of ``rows`` rows."""
    share = min(1.0, bound / max(rows, 1))
    return F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)


def text_slices(
    texts: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[first, last)`` of a text column with their bytes and the offsets of
    each text in them. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        own = offsets[first : last + 1]
        yield first, last, whole[own[0] : own[-1]], own - own[0]
        first = last


def batch_slices(
    batch: pa.RecordBatch, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of a batch, slice by slice, with the bytes of their texts."""
    for first, last, data, offsets in text_slices(batch.column(column)):
        yield batch.slice(first, last - first), data, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once (by sorting, which is much faster here than a hash table)."""
    keys = np.sort(keys)
    if len(keys) < 2:
        return keys
    return keys[np.append(True, keys[1:] != keys[:-1])]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if n > KEPT_POWERS:  # those of a very long text are not kept
        return tuple(_cumulated(base, n) for base in _BASES)
    if len(_powers[0]) < n:
        _powers[:] = [_cumulated(base, KEPT_POWERS) for base in _BASES]
    return _powers[0][:n], _powers[1][:n]


def _cumulated(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def give_back() -> None:
    """Returns what this process no longer uses to the machine, at the end of a stage's work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``out[e] - out[s]`` times the inverse power of ``s`` is the hash of ``data[s:e]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


class Words:
    """The words of a slice, A-Z in lower case: hashes, byte places, first word of each text.

    ``inside`` says which bytes belong to words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _WORD):
        inside = inside[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if len(data):
            sums = prefix_hash(_LOWER[data])
            raw = (sums[self.end] - sums[self.start]) * powers(len(data))[1][self.start]
            self.hash = mixed(raw ^ (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_STEPS = [mixed(np.array([i + 1], np.uint64) * np.uint64(_BASE))[0] | np.uint64(1) for i in range(64)]


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns of word hashes; order counts."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for step, part in zip(_STEPS, parts, strict=False):
        total = total + part * step
    return mixed(total)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and the place of
    each text's first. A text of fewer words has its whole sequence as the only one;
    a text without words has none."""
    counts = np.diff(words.first)
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    room = np.repeat(words.first[1:], counts) - np.arange(n)
    full = np.zeros(n, np.uint64)
    if n >= size:
        full[: n - size + 1] = sequence_hash(
            [words.hash[i : n - size + 1 + i] for i in range(size)]
        )
    keep = room >= size
    for short in range(1, size):
        at = words.first[:-1][counts == short]
        if len(at):
            full[at] = sequence_hash([words.hash[at + i] for i in range(short)])
            keep[at] = True
    places = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)), out=places[1:])
    return full[keep], places
