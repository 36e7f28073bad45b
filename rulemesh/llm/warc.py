"""Web archives: WARC files of captures, revisits of equal payloads, and a merged index.

``write`` turns pages into WARC records, one archive per task and ``FILE_BYTES``. Each
archive is sorted by URL key and time, so its index is a sorted run. Of captures with
an equal payload of ``LEAST_BYTES`` or more, the one with the smallest page_id is the response and the others
are revisits that refer to it. ``read`` parses the archives back into index entries. ``merge_index`` deals all runs out by
ranges of (URL key, time, page), and in every range a loser tree merges the slices of
the runs, so the index is globally ordered: ``position`` is an entry's place in it.

Null html is an empty payload, and a null url an empty key without a Target-URI. A null page_id is
never the smallest; among equal payloads without any page_id all are responses. Repeated rows
are written each; those that repeat the response are responses too. Further columns are not written.
Line ends within a URL are percent-encoded.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import BROADCAST_BYTES
from rulemesh.session import cut_lineage, shared_folder

#: Payloads below this size are always written in full.
LEAST_BYTES = 100
#: About the size of an archive; a reader holds one at a time.
FILE_BYTES = 32 << 20
#: Time of the first capture where pages carry none: page_id seconds are added.
FIRST_CAPTURE = "2024-01-01 00:00:00"
_END = "\r\n"


def url_key(url: Column) -> Column:
    """The host's labels in reverse order, then the rest, in lower case."""
    own = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(own, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(own, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, captured_at, record_type, refers_to.

    The digests are counted before anything moves. Only digests that occur twice join back:
    broadcast where their number proves that small, else by a shuffle whose hot digests Spark splits.
    """
    own = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns(
        {
            "payload_digest": F.sha2("html", 256),
            "payload_bytes": F.octet_length("html").cast("long"),
            "captured_at": F.date_format(
                F.timestamp_seconds(
                    F.unix_timestamp(F.lit(FIRST_CAPTURE).cast("timestamp"))
                    + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))
                ),
                "yyyy-MM-dd'T'HH:mm:ss'Z'",
            ),
        }
    )
    repeated = cut_lineage(
        own.filter(F.col("payload_bytes") >= LEAST_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    if repeated.count() * 100 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    revisit = F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    return own.join(repeated, "payload_digest", "left").select(
        *own.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _record() -> Column:
    """The text of a record but for the line end after it."""

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(_END))

    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, "").otherwise(F.col("html"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", page("page_id")),
        F.coalesce(header("WARC-Target-URI", url), F.lit("")),
        header("WARC-Date", F.col("captured_at")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                header("WARC-Refers-To", page("refers_to")),
                header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(payload).cast("string")),
        F.lit(_END),
        payload,
        F.lit(_END),
    )


def write(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` under ``path``, each sorted by URL key and time. Payloads stay where
    they are read, unless repeated digests are too many to broadcast."""
    rows, total = pages.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600), F.lit(0))
    ).first()
    per_file = max(1, int(FILE_BYTES * rows / max(total, 1)))
    (
        captures(pages)
        .withColumn("url_key", url_key(F.col("url")))
        .sortWithinPartitions("url_key", "captured_at", "page_id")
        .select(_record().alias("value"))
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def records(content: bytes):
    """(offset, length, headers, payload) of each record of an archive."""
    at = 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at) + 4
        lines = content[at : body - 4].decode("utf-8", "replace").split(_END)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at {at}: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        end = body + int(headers["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at {end}")
        yield at, end + 4 - at, headers, content[body:end]
        at = end + 4


ENTRY = (
    "run string, run_place long, record_offset long, record_length long, url string, captured_at string, "
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)
_ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _entry(run: str, place: int, offset: int, length: int, headers: dict, payload: bytes) -> dict:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(headers["WARC-Payload-Length"])
    if headers["WARC-Type"] != "revisit":
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of record at {offset} in {run} has digest {found}")
    values = (
        run, place, offset, length, headers.get("WARC-Target-URI"), headers["WARC-Date"],
        _page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")),
    )
    return dict(zip(_ENTRY_NAMES, values, strict=True))


def read(spark: SparkSession, path: str) -> DataFrame:
    """An index entry for every record of the archives under ``path``; payloads of responses are
    checked against their digests."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                name = batch.column("path")[i].as_py().rsplit("/", 1)[-1]
                rows = [_entry(name, place, *record) for place, record in enumerate(records(content))]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=_schema())

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return archives.select("path", "content").mapInArrow(run, ENTRY)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ENTRY.split(", ")])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner is
    found by replaying one path."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = len(runs)
        self.losers = [-1] * self.size
        for leaf in range(self.size):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # still being built: wait for the other side
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.size and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merge_index(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """All entries with ``url_key`` and ``position``, their place in the global order of
    (url_key, captured_at, page_id, run)."""
    spark = entries.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = cut_lineage(entries.withColumn("url_key", url_key(F.col("url"))))
    names = [*runs.columns, "range_no", "in_range"]
    added = [T.StructField("range_no", T.IntegerType()), T.StructField("in_range", T.LongType())]
    schema = T.StructType([*runs.schema.fields, *added])

    def run(batches):
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = zip(
            rows["url_key"].to_pylist(),
            rows["captured_at"].to_pylist(),
            (-1 if p is None else p for p in rows["page_id"].to_pylist()),
            range(rows.num_rows),
            strict=True,
        )
        slices: dict[str, list] = {}
        for key, name in zip(keys, rows["run"].to_pylist(), strict=True):
            slices.setdefault(name, []).append(key)
        order = [key[-1] for key in LoserTree([slices[name] for name in sorted(slices)])]
        part = TaskContext.get().partitionId()
        for at in range(0, len(order), 10_000):
            took = order[at : at + 10_000]
            out = rows.take(pa.array(took)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([part] * len(took), pa.int32()), pa.array(range(at, at + len(took)), pa.int64())],
                names=names,
            )

    # Within a range, a run's entries come in the order of the run.
    merged = cut_lineage(
        runs.repartitionByRange(ranges, "url_key", "captured_at", F.col("page_id").asc_nulls_first(), "run")
        .sortWithinPartitions("run", "run_place")
        .mapInArrow(run, schema)
    )
    sizes = merged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("range_no", F.coalesce(before, F.lit(0)).alias("before"))  # one row a range
    return merged.join(F.broadcast(starts), "range_no").withColumn(
        "position", F.col("before") + F.col("in_range")
    ).drop("range_no", "in_range", "before")


def archive_and_index(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives into the shared folder, read back, and indexed."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return merge_index(read(pages.sparkSession, path))
