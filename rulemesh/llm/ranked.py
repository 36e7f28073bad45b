"""Ranked lexical search: the best documents of each item, by a hybrid of term-at-a-time and
document-at-a-time evaluation.

The documents are indexed where they lie (``index``): a row a document with its number of terms and, for the terms
that items ask for, their occurrences. No posting is shuffled. Counts over the whole index give the
weights of the terms. Then each task searches its own documents, shard by shard (``Shard``): the short
posting lists of an item are summed first, term at a time, into accumulators; these are
from then on one more iterator, bounded by the greatest of them. The long lists are walked with it
document at a time, by blocks of ascending places: lists whose bounds together cannot lift a document over the
item's current threshold yield no candidates and are only looked into, and a candidate is given up as soon as
what is left cannot lift it over. The threshold, the score of the last of the best so far,
carries over from shard to shard in a task. Each task returns at most ``TOP`` documents an item; these meet in two steps,
over salted groups first.

Items are a stated query set. Their terms are broadcast; a set whose measured size is above ``BLOCK_BYTES`` is parted into
blocks by a hash, and the blocks run one after the other, each result stored.

Null texts and texts without terms are no documents of the index; null items and items without known
terms have no rows. Repeated rows of the documents are documents each. Equal rows of the items count once; different texts
under one ``item_id`` are ranked each. A null ``doc_id`` follows all others among equal
scores. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulemesh.llm.common import LETTERS, batch_slices
from rulemesh.operators.joins import measured_bytes
from rulemesh.session import cut_lineage

TOP = 20
BLOCK_BYTES = 8 << 20
#: Documents and postings of a shard at most (a single larger document is a shard of its own).
SHARD_DOCUMENTS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: A list is short if it holds at most one in so many of a shard's documents.
SHORT_SHARE = 64
#: Documents that are walked together.
WALK = 2048
#: Groups that the tasks' best documents of an item meet in first.
SALTS = 16
_NO_ID = np.iinfo(np.int64).max

_TERMS = np.full(256, 32, np.uint8)
_TERMS[LETTERS] = np.flatnonzero(LETTERS)
_TERMS[65:91] += 32

INDEX_SCHEMA = "doc_id long, length long, terms array<int>, times array<int>"


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """All terms of a slice of texts in order, and how many each text has."""
    folded = np.insert(_TERMS[data], offsets[1:-1], 32)
    begins = folded != 32
    begins[1:] &= folded[:-1] == 32
    before = np.concatenate([[0], np.cumsum(begins)])
    first = offsets[:-1] + np.arange(len(offsets) - 1)
    last = offsets[1:] + np.arange(len(offsets) - 1)
    return folded.tobytes().split(), before[last] - before[first]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, text_key, term, times) of items (item_id, text), equal rows once."""

    def run(batches):
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                terms, counts = _terms(data, offsets)
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                columns = [batch.column(c).take(row) for c in ("item_id", "text_key")]
                words = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*columns, words], names=["item_id", "text_key", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    named = items.select("item_id", F.xxhash64("text").alias("text_key"), "text").dropDuplicates()
    terms = named.mapInArrow(run, f"item_id {kind}, text_key long, term string")
    return terms.groupBy("item_id", "text_key", "term").agg(F.count(F.lit(1)).alias("times"))


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per document of ``docs`` with at least one term: doc_id, length (its terms with repeats), and
    the places in ``terms`` of those it holds, ascending, with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        place = {term.encode(): i for i, term in enumerate(sent.value)}
        size = max(len(place), 1)
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                words, length = _terms(data, offsets)
                found = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                row = np.repeat(np.arange(len(length)), length)
                known = found >= 0
                cell, times = np.unique(row[known] * size + found[known], return_counts=True)
                ends = np.searchsorted(cell, np.arange(len(length) + 1) * size).astype(np.int32)
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(length.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array((cell % size).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "length", "terms", "times"],
                )
                yield out.filter(pa.array(length > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_share(length: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of each document; beyond 64 bits the product is taken in whole numbers of any size."""
    if len(length) and 25 * int(length.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * n * documents // words for n in length.tolist()], np.int64)
    return 75 + 25 * length * documents // words


class Best:
    """The best documents of one item so far."""

    def __init__(self):
        self.score = np.zeros(0, np.int64)
        self.doc = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that can still enter."""
        return int(self.score[-1]) if len(self.score) >= TOP else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Shard:
    """Posting lists of some documents: for each term places of documents, ascending, and what it adds to them."""

    def __init__(self, batch: pa.Table, weights: np.ndarray, documents: int, words: int):
        ids = batch.column("doc_id").combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.doc = ids.fill_null(_NO_ID).to_numpy()
        length = batch.column("length").to_numpy()
        lists, times = (batch.column(c).combine_chunks() for c in ("terms", "times"))
        held = np.diff(lists.offsets.to_numpy())
        place = np.repeat(np.arange(len(held)), held)
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        times = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        share = length_share(length, documents, words)[place]
        adds = weights[term] * (1_000_000_000 * times // (1000 * times + 12 * share))
        order = np.argsort(term, kind="stable")
        self.place, self.adds = place[order], adds[order]
        term = term[order]
        self.known, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.adds, first) if len(term) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Adds to ``best`` what this shard has for an item's terms."""
        at = np.searchsorted(self.known, terms)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == terms[there]
        lists = [
            (self.place[a:b], self.adds[a:b] * t, int(most) * int(t))
            for a, b, t, most in zip(
                self.first[at[there]].tolist(), self.first[at[there] + 1].tolist(), times[there].tolist(), self.most[at[there]], strict=True
            )
        ]
        if not lists:
            return
        limit = len(self.doc) // SHORT_SHARE
        short = [x for x in lists if len(x[0]) <= limit]
        walked = [x for x in lists if len(x[0]) > limit]
        if short:  # term at a time
            places, groups = np.unique(np.concatenate([x[0] for x in short]), return_inverse=True)
            sums = np.zeros(len(places), np.int64)
            np.add.at(sums, groups, np.concatenate([x[1] for x in short]))
            walked.append((places, sums, int(sums.max())))
        walked.sort(key=lambda x: x[2])
        bounds = np.cumsum([x[2] for x in walked])
        for low in range(0, len(self.doc), WALK):  # document at a time
            threshold = best.threshold
            # The lists before this one cannot lift a document over the threshold by themselves.
            leading = int(np.searchsorted(bounds, threshold, "left"))
            if leading == len(walked):
                return
            self._walk(walked, bounds, leading, low, min(low + WALK, len(self.doc)), threshold, best)

    def _walk(self, walked, bounds, leading: int, low: int, high: int, threshold: int, best: Best) -> None:
        score = np.zeros(high - low, np.int64)
        for places, adds, _ in walked[leading:]:
            a, b = np.searchsorted(places, (low, high))
            score[places[a:b] - low] += adds[a:b]
        candidate = np.flatnonzero(score)
        score = score[candidate]
        candidate += low
        for i in range(leading - 1, -1, -1):
            alive = score + bounds[i] >= threshold
            candidate, score = candidate[alive], score[alive]
            if not len(candidate):
                return
            places, adds, _ = walked[i]
            a, b = np.searchsorted(places, (candidate[0], candidate[-1] + 1))
            own = places[a:b]
            at = np.searchsorted(own, candidate)
            hit = at < len(own)
            hit[hit] = own[at[hit]] == candidate[hit]
            score[hit] += adds[a:b][at[hit]]
        alive = score >= threshold
        if alive.any():
            candidate = candidate[alive]
            best.add(score[alive], self.doc[candidate], self.null[candidate])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, postings = [], 0, 0
    for whole in batches:
        ends = whole.column("terms").offsets.to_numpy()
        first = 0
        while first < whole.num_rows:
            room = int(np.searchsorted(ends, ends[first] + SHARD_POSTINGS - postings, "right")) - 1
            last = min(max(room, first + (not rows)), first + SHARD_DOCUMENTS - rows, whole.num_rows)
            if last > first:
                held.append(whole.slice(first, last - first))
                rows += last - first
                postings += int(ends[last] - ends[first])
                first = last
            if first < whole.num_rows:
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _best_of_tasks(indexed: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights, documents, words) -> DataFrame:
    """(query, task, doc_id, score): at most ``TOP`` rows a query and task."""
    sent = indexed.sparkSession.sparkContext.broadcast((queries, weights, documents, words))

    def run(batches):
        queries, weights, documents, words = sent.value
        found = [Best() for _ in queries]
        for table in _shards(batches):
            shard = Shard(table, weights, documents, words)
            for best, (terms, times) in zip(found, queries, strict=True):
                shard.search(terms, times, best)
        sizes = [len(x.score) for x in found]
        if sum(sizes):
            ids = pa.array(np.concatenate([x.doc for x in found]), mask=np.concatenate([x.null for x in found]))
            query = pa.array(np.repeat(np.arange(len(found), dtype=np.int32), sizes))
            score = pa.array(np.concatenate([x.score for x in found]))
            yield pa.RecordBatch.from_arrays([query, ids, score], names=["query", "doc_id", "score"])

    rows = indexed.mapInArrow(run, "query int, doc_id long, score long")
    return rows.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(SALTS)))


def _search_block(docs: DataFrame, asked: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.orderBy("text_key", "term").collect()  # bounded: the items of one block
    terms = sorted({r.term for r in rows})
    place = {term: i for i, term in enumerate(terms)}
    by_query: dict[tuple, list] = {}
    for r in rows:
        by_query.setdefault((r.item_id, r.text_key), []).append((place[r.term], r.times))
    queries = [tuple(np.array(sorted(x), np.int64).T) for x in by_query.values()]

    indexed = cut_lineage(index(docs, terms))
    totals = indexed.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
    held = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = np.zeros(max(len(terms), 1), np.int64)
    for r in held:  # bounded: the terms of one block
        weights[r.term] = weight(totals.documents, r.n)

    best = _best_of_tasks(indexed, queries, weights, totals.documents, totals.words)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for group in (["query", "task"], ["query"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        best = best.filter(F.col("rank") <= TOP)
    kind = asked.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame([(i, k[0]) for i, k in enumerate(by_query)], f"query int, item_id {kind}")
    return best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``TOP`` documents of highest score above 0,
    fewer if there are not as many; equal scores by ascending ``doc_id``."""
    asked = cut_lineage(item_terms(items))
    blocks = max(1, math.ceil(measured_bytes(asked) / block_bytes))
    out = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text_key"), F.lit(blocks)) == block)
        found = _search_block(docs, own)
        if blocks > 1:
            found = cut_lineage(found)
        out = found if out is None else out.unionByName(found)
    return out
