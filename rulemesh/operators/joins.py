"""Join of a large side with a keyed side, safe against hot keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.session import cut_lineage

# A side is broadcast only after its size was measured to be below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows than this on the large side is spread over several tasks.
HOT_ROWS = 2_000_000

@dataclass(frozen=True)
class HotKeys:
    """The keys of a table that have too many rows for one task."""

    rows: int  # of the whole table
    # (key, number of tasks it is spread over); a table holds at most rows / hot_rows of them.
    fanouts: tuple[tuple[object, int], ...] = ()
    nulls: int = 1  # tasks the rows without a key are spread over


def row_bytes(schema: T.StructType) -> Column:
    """What a row takes: text lengths plus 16 a column."""
    width = F.lit(16 * len(schema.fields))
    for field in schema.fields:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return width


def measured_bytes(df: DataFrame) -> int:
    """Size of a table by one aggregation: text lengths plus 16 per column and row."""
    return df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("n")).first()["n"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def stored(df: DataFrame, split_by: str | None = None, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written by :func:`cut_lineage`, with ``rows``, ``bytes`` and the ``measures`` (named
    aggregates, NULL as 0) counted by the write itself. A task that is run again may be counted twice, so the
    figures choose plans and end rounds at 0, and no result depends on them."""
    observed = Observation()
    wanted = {"rows": F.count(F.lit(1)), "bytes": F.sum(row_bytes(df.schema)), **measures}
    table = cut_lineage(df.observe(observed, *(m.alias(n) for n, m in wanted.items())), split_by)
    found = observed.get
    return table, {name: found.get(name) or 0 for name in wanted}


def key_profile(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> HotKeys:
    """Number of rows, and the keys with more than ``hot_rows`` of them.

    One pre-aggregated pass; only if some key is hot a second one fetches the
    list of them, which the number of rows bounds.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(key).isNotNull()
    whole = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.max(F.when(known, F.col("_n"))), F.lit(0)).alias("most"),
        F.coalesce(F.max(F.when(~known, F.col("_n"))), F.lit(0)).alias("nulls"),
    ).first()
    hot = []
    if whole["most"] > hot_rows:
        hot = counts.filter(known & (F.col("_n") > hot_rows)).orderBy(F.col("_n").desc(), key).collect()
    tasks = lambda n: -(-n // hot_rows) + 1
    return HotKeys(
        whole["rows"],
        tuple((row[key], tasks(row["_n"])) for row in hot),
        tasks(whole["nulls"]) if whole["nulls"] > hot_rows else 1,
    )


def keyed_join(
    large: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str = "inner",
    fits: bool = False,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """``large`` joined with ``keyed`` on the column ``key`` both have.

    ``fits`` says that ``keyed`` was measured and may be broadcast: ``large``
    does not move then. Otherwise both sides are shuffled on the key, and the
    rows of every hot key of ``large`` go to several tasks, each of which gets a
    copy of that key's ``keyed`` rows; rows without a key, which match nothing, are spread as
    well. Every large row meets exactly one copy,
    so inner, left, semi and anti joins keep their results. ``rows`` is the number of rows of ``large`` where
    the caller knows it (no key can be hot where all rows together are not), ``hot`` its
    profile where it was taken already.
    """
    if fits:
        return large.join(F.broadcast(keyed), key, how)
    if rows is not None and rows <= hot_rows:
        return large.join(keyed, key, how)
    if hot is None:
        hot = key_profile(large, key, hot_rows)
    if not hot.fanouts and hot.nulls == 1:
        return large.join(keyed, key, how)
    # The partition takes part so that equal rows are spread as well; both parts
    # are the same again when a lost task is repeated.
    spread = F.xxhash64(*(F.col(f"`{c}`") for c in large.columns), F.spark_partition_id())
    kind = large.schema[key].dataType.simpleString()
    known = large.sparkSession.createDataFrame(list(hot.fanouts), f"`{key}` {kind}, _tasks int")

    def with_tasks(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(known), key, "left")

    nulls = F.when(F.col(key).isNull(), F.lit(hot.nulls))
    tasks = F.coalesce("_tasks", nulls, F.lit(1))
    salted = with_tasks(large).withColumn("_salt", F.pmod(spread, tasks).cast("int")).drop("_tasks")
    every = F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)
    copies = with_tasks(keyed).withColumn("_salt", F.explode(every)).drop("_tasks")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
