"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Runs of one symbol become one symbol; then deterministic
coin tossing gives each symbol a small label from the lowest bit in which it differs from its
left neighbour, repeated until labels are below 8; phrases begin where the label is a local
maximum and take the hash of their symbols as name, the next level's symbol. A cut depends on a few
symbols around it alone, so equal substrings are cut and named alike inside,
wherever they stand. The fingerprint keeps the ``KEEP`` least of the mixed names of the second and third
level (phrases of about 6 and 15 bytes; the first level and the bytes too in short texts), and
the likeness of two fingerprints estimates the share of names both texts have.

``with_next`` pairs each text with the following one in descending ``doc_id`` order (after the last
the first): texts are dealt out by ranges of ``doc_id`` and streamed in order, and only the
first and last text of each range meet at the end. Null texts count as empty, and the
empty text has the empty fingerprint, which is like itself only. Repeated ids are ordered by their
text; null ids come last. A single text is its own successor. Further columns are not used.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulemesh.llm.common import SLICE_BYTES, batch_slices, distinct, mixed, powers

KEEP = 64
LEVELS = 3
#: Below so many names of a level, those of the level below are kept as well.
FEW = 8


def _toss_table(bits: int) -> np.ndarray:
    """Label of a symbol for each left neighbour: twice the lowest differing bit, plus that bit."""
    a, b = np.meshgrid(np.arange(1 << bits), np.arange(1 << bits), indexing="ij")
    low = np.zeros(a.shape, np.uint8)
    for k in reversed(range(bits)):
        low[((a ^ b) >> k) & 1 == 1] = k
    return (2 * low + ((b >> low) & 1)).astype(np.uint8).reshape(-1)


_BYTES, _LABELS = _toss_table(8), _toss_table(7)


_NAMED_BYTES = mixed(np.arange(256, dtype=np.uint64))


def _labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A label below 8 for each symbol. The first of a text has 0, so labels know nothing
    of what stands before the text."""
    if symbols.dtype == np.uint8:
        out = _BYTES.take(symbols[1:].astype(np.int32) + (symbols[:-1].astype(np.int32) << 8))
    else:
        differ = symbols[1:] ^ symbols[:-1]
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64) & np.uint64(63)
        out = (2 * low + ((symbols[1:] >> low) & np.uint64(1))).astype(np.uint8)
    out = np.append(np.uint8(0), out)
    for _ in range(3):
        out[starts] = 0
        out[1:] = _LABELS.take(out[1:].astype(np.int32) + (out[:-1].astype(np.int32) << 7))
    out[starts] = 0
    return out


def _level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts of a slice, and where each text's begin. ``first`` has the
    place of each text's first symbol, and the end."""
    n = len(symbols)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    # Runs of one symbol within a text.
    heads = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]) | begins[:-1])
    counts = np.diff(np.append(heads, n))
    names = symbols[heads]
    long = counts > 1
    first = np.searchsorted(heads, first)
    starts = first[:-1][np.diff(first) > 0]
    label = _labels(names, starts)
    wide = _NAMED_BYTES[names] if names.dtype == np.uint8 else mixed(names)
    if long.any():
        wide[long] = mixed(wide[long] + counts[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # A text's first symbol and local maxima of the labels begin phrases; 0 stands after its end.
    following = np.append(label[1:], np.uint8(0))  # text starts have 0 already
    cut = label >= following
    cut[1:] &= label[1:] > label[:-1]
    cut[starts] = True
    heads = np.flatnonzero(cut)
    place = np.arange(len(names)) - np.repeat(heads, np.diff(np.append(heads, len(names))))
    weight = powers(int(place.max()) + 2)[0].take(place + 1)
    named = mixed(np.add.reduceat(wide * weight, heads))
    return named, np.searchsorted(heads, first)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text of a slice: sorted 32-bit numbers."""
    count = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint32)] * count
    symbols, first, levels = data, offsets, [(data, offsets)]
    for _ in range(LEVELS):
        symbols, first = _level(symbols, first)
        levels.append((symbols, first))
    out = []
    for i in range(count):
        own = [names[f[i] : f[i + 1]] for names, f in levels]
        # Levels 2 and 3, in short texts also those below.
        lowest = 0 if len(own[1]) < FEW else 1 if len(own[2]) < FEW else 2
        marks = mixed(np.concatenate([x.astype(np.uint64) for x in own[lowest:]]))
        out.append(distinct((marks >> np.uint64(32)).astype(np.uint32))[:KEEP])
    return out


def as_text(marks: np.ndarray) -> str:
    return marks.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the least names of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = distinct(np.concatenate([a, b]))
    if len(a) == KEEP or len(b) == KEEP:  # beyond, names may be missing in one
        least = least[:KEEP]
    both = np.isin(least, a, assume_unique=True) & np.isin(least, b, assume_unique=True)
    return float(both.sum() / len(least))


def _points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def _byte_place(text: bytes, points: int) -> int:
    """Where the code point number ``points`` begins."""
    if text.isascii():
        return min(points, len(text))
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(starts[points]) if points < len(starts) else len(text)


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of a text, and the text with its last half replaced by the beginning of the following."""
    n = _points(text)
    half = n // 2
    return n, text[: _byte_place(text, n - half)] + following[: _byte_place(following, half)]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), ends


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def compared(rows: list[tuple], prints: list[np.ndarray]) -> pa.RecordBatch:
    """The result of all rows (doc_id, text) but the last, which only follows."""
    changed = [edited(a[1], b[1]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    own = fingerprints(*_joined([t for _, t in changed]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows[:-1]], pa.int64()),
            pa.array([n for n, _ in changed], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for _, t in changed], pa.string()),
            pa.array([as_text(p) for p in prints[:-1]], pa.string()),
            pa.array([as_text(p) for p in own], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(prints[:-1], own, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(prints[:-1], prints[1:], strict=True)], pa.float64()),
        ],
        names=_NAMES,
    )


def _rows(batches):
    for whole in batches:
        for batch, data, offsets in batch_slices(whole):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield list(zip(batch.column("doc_id").to_pylist(), texts, strict=True))


def _stream(batches):
    """All rows of a range but its last, each with its successor."""
    held, held_prints = [], []
    for rows in _rows(batches):
        held_prints += fingerprints(*_joined([t for _, t in rows]))
        held += rows
        yield compared(held, held_prints)
        held, held_prints = held[-1:], held_prints[-1:]


def _borders(batches):
    """The first and the last row of a range."""
    part, first, last = TaskContext.get().partitionId(), None, None  # tasks are numbered as the ranges are
    for rows in _rows(batches):
        first, last = first or rows[0], rows[-1]
    if first:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((part, pa.int32()), (first[0], pa.int64()), (first[1].decode("utf-8", "replace"), pa.string()), (last[0], pa.int64()), (last[1].decode("utf-8", "replace"), pa.string()))],
            names=["part", "first_id", "first_text", "doc_id", "text"],
        )


def _finish(batches):
    """The last row of each range with the first of the next."""
    for batch in batches:
        for row in batch.to_pylist():
            rows = [(row["doc_id"], row["text"].encode()), (None, row["next_text"].encode())]
            yield compared(rows, fingerprints(*_joined([t for _, t in rows])))


def range_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 ids, ascending, that part the documents evenly; any ids would part them rightly."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 20 * ranges))).first()[0]
    return sorted(set(found or []))


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds above ``doc_id``, for null all of them: higher ids get lower numbers. Counted in two
    steps, over every so manieth bound and over those between."""
    step = max(1, math.isqrt(len(bounds)))
    high_first = F.lit(bounds[::-1]).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    above = lambda some: F.size(F.filter(some, lambda b: b > doc_id))
    coarse = F.lit(bounds[::-1][step - 1 :: step]).cast("array<bigint>") if bounds else high_first
    first = above(coarse) * step
    known = first + above(F.slice(high_first, first + 1, F.lit(step)))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(known).cast("int")


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with the likenesses.

    The ranges are fixed before the texts move, so every reading of them, whether it shares a
    shuffle with another or repeats it, finds the same texts in each.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, ranges)
    ordered = rows.repartitionById(len(bounds) + 1, range_of(F.col("doc_id"), bounds)).sortWithinPartitions(
        F.col("doc_id").desc(), "text"
    )
    inner = ordered.mapInArrow(_stream, RESULT)
    edges = ordered.mapInArrow(
        _borders, "part int, first_id long, first_text string, doc_id long, text string"
    )
    # One row a range: its last text meets the first of the next, and the last range the first.
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.coalesce(F.lead("first_text").over(by_part), F.first("first_text").over(whole))
    met = edges.select("doc_id", "text", follows.alias("next_text")).mapInArrow(_finish, RESULT)
    return inner.unionByName(met)
