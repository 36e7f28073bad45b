"""Token ids on disk: Parquet files of id lists that can be read in part.

``write`` encodes documents and writes them in ascending ``doc_id`` order: file after
file, each sorted, with row groups of ``ROW_GROUP_BYTES``, pages of
``PAGE_ROWS`` rows at most, page indexes (Parquet writes them for every column) and dictionary-encoded
ids, 16 bits an id for vocabularies below 65,536. Beside the ids stand ``n_tokens`` and the place of
the document in its file, so lengths and offsets are read without touching the ids, and a range of
``doc_id`` reads only the pages that hold it.

Null texts count as empty: the end id alone. Null ids sort first, repeated ids by
their encoded ids; all rows are written. Further columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.llm.bpe import tokenizer_json, worker
from rulemesh.llm.common import batch_slices, give_back
from rulemesh.llm.fingerprint import range_bounds, range_of
from rulemesh.llm.word_table import WordTable

ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 500
SCHEMA = "doc_id long, file_no int, first_in_file long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, raw): the ids of each text and ``end_id`` as little-endian numbers, of 16 bits where the
    vocabulary allows it. Texts are encoded where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches):
        table = worker(WordTable, sent.value)
        kind = id_type(table.encoder.tokenizer.get_vocab_size(), end_id)
        for whole in batches:
            for batch, data, offsets in batch_slices(whole):
                ids, ends = table.encode_slice(data, offsets)
                ids = np.insert(ids.astype(kind), ends, end_id)
                ends = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * ids.itemsize
                raw = pa.Array.from_buffers(
                    pa.large_binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), raw.cast(pa.binary())], names=["doc_id", "raw"]
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, raw binary")


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, files: int | None = None) -> None:
    """Writes the ids of ``docs`` (doc_id, text), each followed by ``end_id``, under ``path``.

    The encoded ids are dealt out by ranges of ``doc_id``, fixed before, and sorted there, so that
    all files of a lower number hold lower ids. No text is shuffled, and each is encoded once.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    from tokenizers import Tokenizer

    kind = id_type(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id)

    def run(batches):
        file_no, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = batch.column("raw").cast(pa.large_binary())
            width = np.dtype(kind).itemsize
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = raw.buffers()[2]
            ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.zeros(0, kind)
            ends = (ends - ends[0]) // width
            n = np.diff(ends)
            first = place + np.cumsum(n) - n
            place += int(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), file_no, np.int32)), pa.array(first), pa.array(n), lists],
                names=["doc_id", "file_no", "first_in_file", "n_tokens", "ids"],
            )

    bounds = range_bounds(docs, files)
    low_first = F.lit(len(bounds)) - range_of(F.col("doc_id"), bounds)
    dealt = encoded(docs, tokenizer, end_id).repartitionById(len(bounds) + 1, low_first)
    ordered = dealt.sortWithinPartitions("doc_id", "raw")
    (
        ordered.mapInArrow(run, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Documents ``low`` to ``high``; other row groups and pages are passed over."""
    return read(spark, path).filter(F.col("doc_id").between(low, high))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, before): the ids in all earlier files. One row a file, from the lengths alone."""
    from pyspark.sql import Window

    sums = read(spark, path).groupBy("file_no").agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("file_no", F.coalesce(before, F.lit(0)).alias("before"))


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "file_no", "first_in_file")),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "file_no", "first_in_file", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).select("doc_id", "file_no", "first_in_file", "ids").mapInArrow(
        run, "doc_id long, file_no int, first_in_file long, n_tokens long, ids_crc32 long"
    )
    return rows.join(F.broadcast(starts(spark, path)), "file_no").select(
        "doc_id", (F.col("before") + F.col("first_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )
