"""What several operators use: intermediate tables, batches of bounded bytes, words, and the rows two hot sides share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.staging import Staging

#: Characters that separate words, and the pattern of one word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of Python code looks at; a longer single text makes a step of its own.
STEP_BYTES = 4 << 20
#: Most rows of a side that may be asked to be broadcast; its rows are a few numbers or a short key each.
BROADCAST_ROWS = 100_000
#: Spark's setting to delete the shuffle files of a query once it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch(Staging):
    """Intermediate tables below the shared folder, which can be dropped once nothing reads them any more."""

    def table_freeing(self, name: str, frame: DataFrame) -> DataFrame:
        """A table whose shuffle files go as soon as it is written: what reads it needs only the table."""
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            return self.table(name, frame)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, or a longer one if a column of ``frame`` is called that or begins like that."""
    while any(c.lower().startswith(name.lower()) for c in frame.columns):
        name = f"_{name}"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def small(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """``frame`` marked for broadcast if it was counted and is small, else as it is."""
    rows = frame.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def worker_state() -> dict:
    """What this Python worker keeps between tasks."""
    return sys.modules.setdefault("faultline_worker_state", ModuleType("faultline_worker_state")).__dict__


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", encoding: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about STEP_BYTES of text each, and their texts as UTF-8 (null: empty).

    Workers outlive tasks, so the token encoders are let go here, unless this task is ``encoding`` itself.
    """
    if not encoding:
        worker_state().pop("encoders", None)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        ends = pc.cumulative_sum(lengths).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(done + STEP_BYTES, side="right")))
            step = pc.fill_null(texts.slice(start, stop - start).cast(pa.large_binary()), b"")
            yield batch.slice(start, stop - start), step.to_pylist()
            start = stop
        # Arrow keeps what a batch took, about as much as an encoder, unless asked for it
        pa.default_memory_pool().release_unused()
