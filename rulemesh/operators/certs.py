"""Certificate sets: duplicates and what follows from trusted issuers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rulemesh.operators.joins import BROADCAST_BYTES, HOT_ROWS, key_profile, stored
from rulemesh.session import shared_folder

# The certificates of a round are sent to the edges if they were measured to be below this.
SENT_BYTES = BROADCAST_BYTES // 4


def unique_certs(source: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``der_sha256, path``: first regular file, by name, of each digest.

    ``source`` has ``path, is_symlink, der_sha256``. Symbolic links of the
    source are skipped; digests of ``exclude`` are left out, links or not.
    """
    regular = source.filter(~F.col("is_symlink") & F.col("der_sha256").isNotNull())
    first = regular.groupBy("der_sha256").agg(F.min("path").alias("path"))
    if exclude is None:
        return first
    taken = exclude.filter(F.col("der_sha256").isNotNull()).select("der_sha256")
    return first.join(taken, "der_sha256", "left_anti")


def _packed(digest: Column) -> Column:
    """A digest in half its bytes: 64 lower-case hexadecimal digits become the 32 bytes they stand for,
    any other text stands behind 33 zero bytes."""
    is_digest = (F.octet_length(digest) == 64) & (F.lower(F.hex(F.unhex(digest))) == digest)
    return F.when(is_digest, F.unhex(digest)).otherwise(F.concat(F.lit(bytes(33)), digest.cast("binary")))


def _unpacked(packed: Column) -> Column:
    text = F.substring(packed, 34, 2**31 - 1).cast("string")
    return F.when(F.length(packed) == 32, F.lower(F.hex(packed))).otherwise(text)


def _bucketed(table: DataFrame, buckets: int, *columns: str, move: bool = True) -> tuple[DataFrame, str, int]:
    """``table`` written once, dealt out by ``columns``; a join on these does not move it again.

    It is registered under a name of its own, since Spark keeps the dealing of files
    for named tables only. Without ``move`` it lies dealt out by ``columns`` already. Returns the table,
    its name and its number of rows.
    """
    spark = table.sparkSession
    name = f"rulemesh_edges_{uuid.uuid4().hex}"
    observed = Observation()
    counted = table.observe(observed, F.count(F.lit(1)).alias("rows"))
    (
        (counted.repartition(buckets, *columns) if move else counted)
        .write.bucketBy(buckets, *columns)
        .sortBy(*columns)
        .option("path", f"{shared_folder(spark)}/{name}")
        .saveAsTable(name)
    )
    return spark.table(name), name, observed.get.get("rows") or 0


def trusted_closure(
    roots: DataFrame, candidates: DataFrame, issues: DataFrame, hot_rows: int = HOT_ROWS, buckets: int | None = None
) -> DataFrame:
    """``der_sha256, round``: roots (round 0) and candidates reached from them.

    ``issues(issuer_sha256, subject_sha256)`` says which certificate validates
    under which. In every round the subjects issued by the last round's certificates
    join the set, until a round adds none.

    Digests are packed. The edges are stored where they lie; as long as a round's certificates were measured to fit, they
    are sent to them. Before the first round that does not fit, the edges not used so far are written once more, dealt out by
    issuer; used ones cannot add anything. The candidates and each round's certificates are kept dealt out by digest, so
    that of a round only the distinct subjects reached move. An issuer of very many
    subjects is spread over several buckets, to each of which it is sent.
    """
    spark = issues.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names, paths, sizes, rounds = [], [], [], []

    def kept(df: DataFrame, *columns: str, move: bool = False) -> tuple[DataFrame, int]:
        table, name, rows = _bucketed(df, buckets, *columns, move=move)
        names.append(name)
        return table, rows

    def trust(df: DataFrame) -> bool:
        """Keeps the certificates of a round; False if there are none."""
        table, rows = kept(df, "der_sha256")
        if rows:
            rounds.append(table)
            paths.append(f"{shared_folder(spark)}/{names[-1]}")
            sizes.append(table.agg(F.sum(16 + F.coalesce(F.octet_length("der_sha256"), F.lit(0)))).first()[0])
        return rows > 0

    edges, _ = stored(issues.select(*(_packed(F.col(c)).alias(c) for c in ("issuer_sha256", "subject_sha256"))))
    edges = edges.dropna()
    keys, hot, dealt = ["issuer_sha256"], (), False

    def with_parts(df: DataFrame) -> DataFrame:
        parts = spark.createDataFrame(list(hot), "issuer_sha256 binary, parts int")
        joined = df.join(F.broadcast(parts), "issuer_sha256", "left")
        return joined.withColumn("parts", F.coalesce("parts", F.lit(1)))

    def as_issuers(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables).select(F.col("der_sha256").alias("issuer_sha256"))

    digest = _packed(F.col("der_sha256")).alias("der_sha256")
    try:
        known, _ = kept(candidates.select(digest).distinct(), "der_sha256")
        added = trust(roots.select(digest).distinct())
        while added:
            issuers, sent = as_issuers(rounds[-1:]), sizes[-1] <= SENT_BYTES
            if not sent and not dealt:
                if sum(sizes[:-1]) <= SENT_BYTES and rounds[:-1]:
                    edges = edges.join(F.broadcast(as_issuers(rounds[:-1])), "issuer_sha256", "left_anti")
                edges, rows = kept(edges, *keys, move=True)
                # No issuer can be hot where all edges together are not; counting them moves nothing.
                hot = key_profile(edges, "issuer_sha256", hot_rows).fanouts if rows > hot_rows else ()
                if hot:
                    keys.append("part")
                    part = F.pmod(F.xxhash64("subject_sha256"), F.col("parts")).cast("int").alias("part")
                    spread = with_parts(edges).select("issuer_sha256", part, "subject_sha256")
                    edges, _ = kept(spread, *keys, move=True)
                dealt = True
            if hot:
                every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
                issuers = with_parts(issuers).select("issuer_sha256", every)
            reached = edges.join(F.broadcast(issuers) if sent else issuers, keys, "left_semi")
            new = known.join(
                reached.select(F.col("subject_sha256").alias("der_sha256")).distinct(), "der_sha256", "left_semi"
            )
            small = [table for table, size in zip(rounds, sizes, strict=True) if size <= SENT_BYTES]
            large = [table for table, size in zip(rounds, sizes, strict=True) if size > SENT_BYTES]
            if small:
                taken = reduce(DataFrame.unionByName, small)
                fits = sum(size for size in sizes if size <= SENT_BYTES) <= BROADCAST_BYTES
                new = new.join(F.broadcast(taken) if fits else taken, "der_sha256", "left_anti")
            for taken in large:
                new = new.join(taken, "der_sha256", "left_anti")
            added = trust(new)
        found = spark.createDataFrame([], "der_sha256 binary, round int")
        for place, path in enumerate(paths):  # the files, since the names end here
            table = spark.read.schema("der_sha256 binary").parquet(path)
            found = found.unionByName(table.withColumn("round", F.lit(place)))
        return found.select(_unpacked(F.col("der_sha256")).alias("der_sha256"), "round")
    finally:
        for name in names:  # the names; the files go with the shared folder
            spark.sql(f"DROP TABLE IF EXISTS {name}")
