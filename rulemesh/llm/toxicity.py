"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

A text's features are its distinct words (letters and digits), word pairs and skip pairs (the words one
and two places apart), hashed into ``2 ** BITS`` buckets. ``fit`` learns from a
sample of labelled rows, bounded by ``max_rows``: per-coordinate learning rates,
and an L1 term that leaves only telling buckets with a weight. The weights, at most
``2 ** BITS`` of them, are broadcast; scoring moves no row.

Null and empty texts have no features and score the learnt bias. Repeated rows are
scored each. Further columns are kept by ``score`` (which adds ``score`` and
``predicted``, replacing columns of these names).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import (
    LETTERS,
    Words,
    distinct,
    fold,
    fresh,
    give_back,
    mixed,
    sample_share,
    sequence_hash,
    text_slices,
)

BITS = 20
#: At most about this many labelled rows are learnt from.
MAX_ROWS = 16_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.0
HELD_OUT_PARTS = 5


@dataclass(frozen=True)
class Weights:
    """The buckets with a weight, and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of text numbers and buckets: words, neighbours, skip pairs."""
    words = Words(data, offsets, LETTERS)
    text = words.text_of()
    down = np.uint64(64 - BITS)
    yield text, (words.hash >> down).astype(np.int64)
    for gap, seed in ((1, 0), (2, 0x5851F42D4C957F2D)):
        if len(text) > gap:
            same = text[gap:] == text[:-gap]
            both = sequence_hash([words.hash[:-gap], words.hash[gap:]])
            yield text[gap:][same], (mixed(both[same] ^ np.uint64(seed)) >> down).astype(np.int64)


def _distinct_features(texts: pa.Array) -> Iterator[np.ndarray]:
    for first, last, data, offsets in text_slices(texts):
        parts = list(_features(data, offsets))
        keys = distinct(np.concatenate([(t.astype(np.int64) << BITS) | b for t, b in parts]))
        ends = np.searchsorted(keys, np.arange(1, last - first + 1, dtype=np.int64) << BITS)
        start = 0
        for end in ends:
            yield (keys[start:end] & ((1 << BITS) - 1)).astype(np.int32)
            start = end


def ftrl(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """Online FTRL-proximal over the rows, ``EPOCHS`` times, in an order drawn with a
    fixed seed."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weight(at: np.ndarray) -> np.ndarray:
        own = z[at]
        shrunk = np.where(np.abs(own) <= L1, 0.0, own - np.sign(own) * L1)
        shrunk[-1] = own[-1]  # no penalty on the bias
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(17)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            buckets, label = rows[i]
            at = np.append(buckets, size)
            w = weight(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weight(np.arange(size + 1))
    found = np.flatnonzero(w[:-1])
    return Weights(found, w[found].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Weights:
    """Weights learnt from ``labels.toxic`` of documents outside the held-out fold.

    The labels drawn (about ``max_rows`` at most) are broadcast to the documents; one
    task learns from the texts they meet, in the order of ``doc_id``. Without labelled
    rows all scores are 0.5.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).filter(
        F.col("doc_id").isNotNull()
        & F.col("_toxic").isin(0, 1)
        & (fold(F.col("doc_id"), HELD_OUT_PARTS) != 0)
    )
    rows = usable.count()
    drawn = usable.filter(sample_share(rows, max_rows)).groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def features(batches):
        for batch in batches:
            taken = [x.tobytes() for x in _distinct_features(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_toxic"), pa.array(taken, pa.binary())],
                names=["doc_id", "_toxic", "buckets"],
            )

    def learn(batches):
        rows = [
            (i.as_py(), np.frombuffer(b.as_buffer(), np.int32), t.as_py())
            for batch in batches
            for i, t, b in zip(*batch.columns, strict=True)
        ]
        if rows:
            rows.sort(key=lambda r: (r[0], zlib.crc32(r[1]), r[2]))
            learnt = ftrl([(b, t) for _, b, t in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(learnt.bucket, -1), pa.int64()),
                    pa.array(np.append(learnt.weight, learnt.bias), pa.float64()),
                ],
                names=["bucket", "weight"],
            )
        rows.clear()
        give_back()

    drawn_rows = known.mapInArrow(features, "doc_id long, _toxic int, buckets binary")
    learnt = (
        drawn_rows.repartition(1).mapInArrow(learn, "bucket long, weight double").toPandas()
    )
    own = learnt[learnt["bucket"] >= 0]
    bias = float(learnt.loc[learnt["bucket"] < 0, "weight"].sum())
    return Weights(
        own["bucket"].to_numpy(np.int64), own["weight"].to_numpy(np.float32), bias
    )


def scores(texts: pa.Array, dense: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for first, last, data, offsets in text_slices(texts):
        hit = []
        for text, bucket in _features(data, offsets):
            told = dense[bucket] != 0
            hit.append((text[told].astype(np.int64) << BITS) | bucket[told])
        keys = distinct(np.concatenate(hit))
        sums = np.bincount(
            keys >> BITS, weights=dense[keys & ((1 << BITS) - 1)], minlength=last - first
        )
        out.append(1.0 / (1.0 + np.exp(-np.clip(sums + bias, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def with_scores(docs: DataFrame, weights: Weights, names: tuple[str, str]) -> DataFrame:
    """``docs`` with the score (0 to 1) and the prediction (1 from 0.5 on) under ``names``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.drop(*names)

    def apply(batches):
        dense = np.zeros(1 << BITS, np.float32)
        dense[sent.value.bucket] = sent.value.weight
        for batch in batches:
            p = scores(batch.column("text"), dense, sent.value.bias)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, *names],
            )
        give_back()

    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return kept.mapInArrow(apply, T.StructType([*kept.schema.fields, *added]))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    return with_scores(docs, weights, ("score", "predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic; columns unchanged."""
    names = (fresh(docs, "toxicity"), fresh(docs, "rejected"))
    scored = with_scores(docs, fit(docs, labels), names)
    return scored.filter(F.col(names[1]) == 0).drop(*names)
