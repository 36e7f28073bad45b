"""Language of texts by error-correcting output codes.

Every language has a codeword; each bit of it splits the languages in two, and a binary
classifier over hashed byte bigrams and trigrams predicts the bit. Its weights are log odds of n-grams
between the two sides. Decoding adds up, for each codeword, the logistic loss of its bits at the
classifiers' margins, so an unsure bit weighs little, and takes the codeword of
least loss. ``score`` is its share among all codewords; ``ambiguous`` marks texts where the
runner-up is close.

The n-gram counts are learnt on a sample of about ``max_rows`` labelled texts at most, counted where they
lie and added up per language and bucket. Weights (``2 ** BITS`` buckets a bit) are broadcast.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if
nothing was learnt. Labels with null language or text teach nothing. Repeated rows are
predicted each. Other columns are kept.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import batch_slices, fold, sample_share

BITS = 16
MAX_ROWS = 20_000
#: Bounds the counts and weights that pass through the driver.
MAX_LANGUAGES = 500
HELD_OUT_PARTS, HELD_OUT = 4, 2
#: Up to so many languages all splits are bits; beyond, a fixed number is drawn.
ALL_SPLITS = 6
SMOOTHING = 0.5
#: How sharply margins count, and the score below which a text is ambiguous.
SHARPNESS = 1.0
AMBIGUOUS_BELOW = 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # one row a language, of +1 and -1
    weights: np.ndarray  # one row a bucket (and one of zeros), one column a bit


def codewords(n: int) -> np.ndarray:
    """``n`` codewords: all splits of a few languages, else the drawn set whose nearest two
    codewords are farthest apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= ALL_SPLITS:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    draw = np.random.default_rng(43)
    best = None
    for _ in range(50):
        code = draw.choice((1.0, -1.0), (n, 8 * int(np.ceil(np.log2(n)))))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        agree = code @ code.T
        np.fill_diagonal(agree, -np.inf)
        if best is None or agree.max() < best[0]:
            best = agree.max(), code
    return best[1]


def buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two rows of buckets, one a byte: bigrams and trigrams that start there and end in the
    same text, else the bucket without weight."""
    wide = np.zeros(len(data) + 2, np.uint32)
    wide[:-2] = _LOWER[data]
    n = len(data)
    two = wide[:n] * np.uint32(0x9E3779B1) + wide[1 : n + 1] * np.uint32(0x85EBCA6B)
    three = two + wide[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    out = np.empty((2, n), np.int32)
    for row, hashed in zip(out, (two, three), strict=True):
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        row[:] = hashed >> np.uint32(32 - BITS)
    ends = offsets[1:][np.diff(offsets) > 0]
    out[:, ends - 1] = 1 << BITS
    out[1, np.maximum(ends - 2, 0)] = 1 << BITS
    return out


def fit(docs: DataFrame, trains: Column, max_rows: int = MAX_ROWS) -> Model:
    """A model of the languages in ``docs.lang``, learnt from rows for which ``trains`` holds."""
    usable = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows, languages = usable.agg(F.count(F.lit(1)), F.approx_count_distinct("lang")).first()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"about {languages} languages; at most {MAX_LANGUAGES} are learnt")
    drawn = usable.filter(sample_share(rows, max_rows)).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                grams = buckets(data, offsets)
                languages = batch.column("lang").to_pylist()
                for i, language in enumerate(languages):
                    own = grams[:, offsets[i] : offsets[i + 1]].reshape(-1)
                    if language not in totals:
                        totals[language] = np.zeros((1 << BITS) + 1, np.int64)
                    totals[language] += np.bincount(own, minlength=(1 << BITS) + 1)
        for language, total in totals.items():
            found = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(found), pa.string()), pa.array(found), pa.array(total[found])],
                names=["lang", "bucket", "n"],
            )

    counts = (
        drawn.mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(counts["lang"].unique())
    code = codewords(len(languages))
    share = np.zeros((len(languages), 1 << BITS))
    for i, language in enumerate(languages):
        own = counts[counts["lang"] == language]
        share[i, own["bucket"].to_numpy(np.int64)] = own["n"]
    share += SMOOTHING
    share /= share.sum(axis=1, keepdims=True)
    weights = np.zeros(((1 << BITS) + 1, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, other = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(one) and len(other):
            weights[:-1, bit] = np.log(one.mean(axis=0)) - np.log(other.mean(axis=0))
    return Model(languages, code, weights)


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text, one column a bit: the log odds of its n-grams over the root of their number."""
    out = np.zeros((len(offsets) - 1, model.code.shape[1]))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        grams = buckets(data, offsets)
        for row in grams:
            out[full] += np.add.reduceat(model.weights[row], offsets[full], axis=0)
        out[full] /= np.sqrt(np.diff(offsets)[full])[:, None]
    return out


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword of least loss for each row of margins, and its share."""
    at = SHARPNESS * margin[:, None, :] * model.code[None, :, :]
    loss = np.logaddexp(0, -at).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    return best, share[np.arange(len(best)), best]


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    counts = np.append(0, np.cumsum(_LETTER[data]))
    out = counts[offsets[1:]] > counts[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(c.isalpha() for c in text)
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``, from ``text`` alone."""
    names = ["lang_pred", "score", "ambiguous"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*names)

    def run(batches):
        learnt = sent.value
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                told = has_letter(data, offsets) & bool(learnt.languages)
                languages, score = ["und"] * len(told), np.zeros(len(told))
                if learnt.languages:
                    best, share = decode(learnt, margins(learnt, data, offsets))
                    score = np.where(told, share, 0.0)
                    languages = [learnt.languages[b] if t else "und" for b, t in zip(best, told, strict=True)]
                added = [pa.array(languages, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS_BELOW)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *added], names=[*batch.schema.names, *names]
                )

    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def held_out() -> Column:
    return fold(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT
