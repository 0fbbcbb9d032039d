"""Token ids in ORC files: integer run-length encoded lists, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.llm.shared import small, steps
from faultline.llm.tokens import encoder


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, stripe_bytes: int = 64 << 20, index_rows: int = 1_000) -> None:
    """Writes doc_id, ids, n_tokens, shard, place and shard_start to ``path``, in ascending doc_id order over shards and within.

    Texts are range-partitioned by doc_id (null first) and a row number, so one shard is one file, and rows that share a
    doc_id are spread over several. ``shard_start`` counts the ids before a document in its shard. A null text counts as
    empty and is one end id. Repeated rows are written each. Other columns of ``docs`` are dropped. An empty table writes
    files without rows.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        shard, place, start = TaskContext.get().partitionId(), 0, 0
        for batch, texts in steps(batches, encoding=True):
            bodies = [body + end for body in words.encode(texts)]
            counts = np.array([len(b) // 4 for b in bodies], np.int64)
            ends = np.cumsum(counts)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(bodies))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            n = len(bodies)
            columns = [
                batch.column(0),
                lists,
                pa.array(counts.astype(np.int32)),
                pa.array(np.full(n, shard, np.int32)),
                pa.array(np.arange(place, place + n)),
                pa.array(start + ends - counts),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "shard", "place", "shard_start"])
            place, start = place + n, start + int(ends[-1])

    key = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    ordered = slim.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows = ordered.mapInArrow(encoded, f"doc_id {key}, ids array<int>, n_tokens int, shard int, place bigint, shard_start bigint")
    (
        rows.write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files as a table; ids, read stripe by stripe in parallel."""
    schema = "doc_id bigint, ids array<int>, n_tokens int, shard int, place bigint, shard_start bigint"
    found = spark.read.orc(path)
    return found if found.columns else spark.read.schema(schema).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; stripes and row groups without them are skipped by indexes and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def index(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [batch.column(0), pa.array(sums, pa.int64()), pa.array(np.diff(ends).astype(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids_crc32", "n_tokens", "shard", "shard_start"])

    files = read(spark, path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    key = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "ids", "shard", "shard_start").mapInArrow(
        summed, f"doc_id {key}, ids_crc32 bigint, n_tokens bigint, shard int, shard_start bigint"
    )
    return rows.join(small(starts), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32"
    )
