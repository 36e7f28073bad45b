"""Marked places in texts: what the scans for personal data and secrets share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPARK = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def ordered(found: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    """By start, then by the order of the kinds."""
    place = {kind: i for i, kind in enumerate(kinds)}
    found.sort(key=lambda x: (x[1], place[x[0]], x[2]))
    return [{"kind": k, "start": a, "end": b} for k, a, b in found]


def of_kinds(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def count(spans: str, kind: str) -> Column:
    return F.size(of_kinds(spans, (kind,))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def digests(spans: str, base: tuple[str, ...]) -> list[Column]:
    """n_<kind> of the base kinds, base_sha256 and spans."""
    return [
        *(count(spans, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(of_kinds(spans, base)), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    ]
