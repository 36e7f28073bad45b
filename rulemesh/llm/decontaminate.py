"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows.

For each benchmark item of L words, every window of L words of a document is a
possible leak (a text of fewer words is one window). Windows and items have 64-bit SimHash
fingerprints of their five-word shingles, each weighted by how often it occurs. A multi-index over ``BLOCKS`` bytes of the
fingerprint finds all items of that length within ``RADIUS`` bits: then some byte differs in
at most ``RADIUS // BLOCKS`` bits, so looking up each byte's neighbours misses none.
Candidates within the radius are confirmed by the exact weighted similarity, the sum of the
lesser counts over the sum of the greater, of 0.75 or more.

At that similarity two windows of n shingles share at least 6/7 of them, so only
windows with that many benchmark shingles are fingerprinted; this drops no confirmed pair. A
similarity of 0.75 of shingles that occur once means about 11 differing bits with a deviation of
3, so the radius loses about one such pair in 50,000 at the threshold and fewer above. A repeated
shingle votes with its count, which moves more bits at equal similarity: windows that hold one, and
all of an item length where an item does, are also compared exactly, radius or not, by
the lists of the items that hold each shingle.

Items are the query set: they are taken in blocks of at most ``BLOCK_BYTES`` of text,
each broadcast to one pass over the documents. No document moves.

Null and empty texts, and items without words, match nothing. Items of fewer than five
words are one sequence. Repeated rows and items are matched each. Other columns are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import (
    SHINGLE_WORDS,
    Words,
    batch_slices,
    distinct,
    fresh,
    give_back,
    sequence_hash,
    shingles,
    text_slices,
)
from rulemesh.llm.common import SIMILARITY_PERCENT as LEAST

BLOCKS = 8
RADIUS = 23
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Running counts of set bits, one column a bit."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint (8 bytes) of ``size`` shingles from each start on: a shingle that
    occurs twice votes twice."""
    votes = sums[starts + size] - sums[starts]
    return np.packbits(2 * votes > size, axis=1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sums of the lesser and of the greater counts of the shingles of two windows."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least, len(a) + len(b) - least


def repeating(own: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of ``size`` shingles from each start on holds one twice."""
    order = np.argsort(own, kind="stable")
    before = np.full(len(own), -1, np.int64)
    same = own[order][1:] == own[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    return np.maximum.accumulate(before)[starts + size - 1] >= starts


class Group:
    """The items of one length: shingles, fingerprints, and the multi-index over these."""

    def __init__(self, words: int):
        self.words = words
        self.size = max(words - SHINGLE_WORDS + 1, 1)
        self.ids: list[int] = []
        self.shingles: list[np.ndarray] = []

    def finish(self) -> None:
        self.prints = np.vstack([fingerprints(bit_sums(s), np.array([0]), len(s)) for s in self.shingles])
        self.repeats = any(len(np.unique(s)) < len(s) for s in self.shingles)
        self.lists = None
        # tables[b, v]: the items whose byte b is close enough to v
        self.tables = np.stack([_NEAR[:, self.prints[:, b]] for b in range(BLOCKS)])

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window and an item within the radius."""
        met = np.zeros((len(prints), len(self.ids)), bool)
        for b in range(BLOCKS):
            met |= self.tables[b][prints[:, b]]
        window, item = np.nonzero(met)
        far = _ONES[prints[window] ^ self.prints[item]].sum(axis=1)
        return window[far <= RADIUS], item[far <= RADIUS]

    def alike(self, window: np.ndarray) -> list[int]:
        """All items whose weighted similarity to a window reaches the threshold."""
        if self.lists is None:
            counted = [np.unique(s, return_counts=True) for s in self.shingles]
            every = np.concatenate([x for x, _ in counted])
            order = np.argsort(every, kind="stable")
            item = np.repeat(np.arange(len(counted)), [len(x) for x, _ in counted])
            self.lists = every[order], item[order], np.concatenate([n for _, n in counted])[order]
        every, item, count = self.lists
        own, n = np.unique(window, return_counts=True)
        a, b = np.searchsorted(every, own), np.searchsorted(every, own, "right")
        held = b - a
        at = np.arange(held.sum()) + np.repeat(a - (np.cumsum(held) - held), held)
        items, where = np.unique(item[at], return_inverse=True)
        least = np.bincount(where, np.minimum(count[at], np.repeat(n, held)), len(items)).astype(np.int64)
        return items[100 * least >= LEAST * (len(window) + self.size - least)].tolist()


class Index:
    def __init__(self, ids: list[int], texts: pa.Array):
        self.groups: dict[int, Group] = {}
        for first, _, data, offsets in text_slices(texts):
            words = Words(data, offsets)
            every, places = shingles(words)
            for i, n in enumerate(np.diff(words.first).tolist()):
                if n:
                    group = self.groups.setdefault(n, Group(n))
                    group.ids.append(ids[first + i])
                    group.shingles.append(every[places[i] : places[i + 1]])
        for group in self.groups.values():
            group.finish()
        self.short = [g for g in self.groups.values() if g.words < SHINGLE_WORDS]
        self.long = [g for g in self.groups.values() if g.words >= SHINGLE_WORDS]
        self.known, self.filter = {}, {}
        for name, groups in [("long", self.long), *((g.words, [g]) for g in self.short)]:
            known = distinct(np.concatenate([np.zeros(0, np.uint64), *(s for g in groups for s in g.shingles)]))
            self.known[name] = known
            self.filter[name] = np.zeros(1 << _FILTER_BITS, bool)
            self.filter[name][known >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, name, hashes: np.ndarray) -> np.ndarray:
        """Which shingles occur in an item."""
        out = self.filter[name][hashes >> np.uint64(64 - _FILTER_BITS)]
        maybe = np.flatnonzero(out)
        if len(maybe):
            known = self.known[name]
            at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            out[maybe] = known[at] == hashes[maybe]
        return out

    def _confirm(self, group: Group, own: np.ndarray, sums: np.ndarray, starts: np.ndarray, size: int, found: dict):
        def met(w: int, i: int) -> None:
            least, most = weighted_similarity(own[w : w + size], group.shingles[i])
            if 100 * least >= LEAST * most:
                key = group.ids[i]
                best = found.get(key)
                if best is None or (least / most, -w) > (best[0], -best[1]):
                    found[key] = (least / most, w)

        for at in range(0, len(starts), 4096):
            part = starts[at : at + 4096]
            window, item = group.candidates(fingerprints(sums, part, size))
            for w, i in zip(part[window].tolist(), item.tolist(), strict=True):
                met(w, i)
        for w in (starts if group.repeats else starts[repeating(own, starts, size)]).tolist():
            for i in group.alike(own[w : w + size]):
                met(w, i)

    def search(self, own: np.ndarray, hit: np.ndarray, n_words: int, groups: list[Group]) -> dict:
        """Items met by one text: id -> (similarity, first word of the best window)."""
        found: dict[int, tuple[float, int]] = {}
        counts = np.append(0, np.cumsum(hit))
        sums = None
        for group in groups:
            if n_words >= group.words:
                size = group.size
                shared = counts[size:] - counts[:-size]
                starts = np.flatnonzero((100 + LEAST) * shared >= 2 * LEAST * size)
            elif 100 * len(own) >= LEAST * group.size and n_words >= SHINGLE_WORDS:
                size, starts = len(own), np.array([0])
            else:
                continue
            if len(starts):
                sums = bit_sums(own) if sums is None else sums
                self._confirm(group, own, sums, starts, size, found)
        return found

    def slice_matches(self, data: np.ndarray, offsets: np.ndarray) -> list[dict]:
        words = Words(data, offsets)
        out: list[dict] = [{} for _ in range(len(offsets) - 1)]
        n_words = np.diff(words.first)

        def texts(name, every, places, groups):
            hit = self.hits(name, every)
            totals = np.append(0, np.cumsum(hit))
            for i in np.flatnonzero(totals[places[1:]] > totals[places[:-1]]).tolist():
                a, b = places[i], places[i + 1]
                out[i].update(self.search(every[a:b], hit[a:b], int(n_words[i]), groups))

        if self.long:
            texts("long", *shingles(words), self.long)
        for group in self.short:
            n = group.words
            room = np.repeat(words.first[1:], n_words) - np.arange(len(words.hash)) >= n
            if room.any():
                every = sequence_hash([words.hash[i : len(words.hash) - n + 1 + i] for i in range(n)])
                places = np.append(0, np.cumsum(np.maximum(n_words - n + 1, 0)))
                texts(n, every[room[: len(every)]], places, [group])
        return out


MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))


def _pass(docs: DataFrame, items: pa.Table, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(
        (items["item_id"].to_pylist(), items["text"].combine_chunks())
    )
    kept = docs.drop(name)

    def run(batches):
        index = Index(*sent.value)
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                rows = [
                    [{"item_id": k, "similarity": s, "first_word": w} for k, (s, w) in sorted(own.items())]
                    for own in index.slice_matches(data, offsets)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, name]
                )
        give_back()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, MATCH)]))


def matches(docs: DataFrame, items: DataFrame, name: str = "leaks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the items met by each text under ``name``: item_id, similarity, and the
    first word of the best window, by item_id."""
    items = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found, names = docs, []
    for block in range(blocks):
        names.append(fresh(found, f"{name}_{block}"))
        found = _pass(found, items.filter(own == block).orderBy("item_id", "text").toArrow(), names[-1])
    every = reduce(lambda a, b: F.concat(a, b), map(F.col, names))
    return found.withColumn(name, F.array_sort(every)).drop(*names)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns unchanged."""
    name = fresh(docs, "leaks")
    return matches(docs, items, name).filter(F.size(name) == 0).drop(name)
