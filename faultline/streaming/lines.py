"""Streaming forms of parsing and of first-seen errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.operators import detect
from faultline.operators.parse import dispatch
from faultline.operators.parse.forms import LogFormat
from faultline.operators.templates import keyed_errors
from faultline.streaming.rates import timed


def read(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Appended log files as a stream of ``log_id, raw_line``; a stream gives no line numbers."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("raw_line")
    )


def parse(lines: DataFrame, log_format: str | LogFormat, cfg: Settings) -> DataFrame:
    """Entries of a declared format, by the same expressions as in batch.

    Python logs are read line by line; ``stateful.python_entries`` merges their tracebacks where lines are numbered.
    """
    if "line_number" not in lines.columns:
        lines = lines.withColumn("line_number", F.lit(None).cast("bigint"))
    known = detect.KNOWN[log_format] if isinstance(log_format, str) else log_format
    return dispatch.entries(dispatch.parse_lines(lines, [known], cfg))


def first_seen_errors(entries: DataFrame, lateness: str) -> DataFrame:
    """The first error of every template per log, within the watermark."""
    keyed = timed(keyed_errors(entries), lateness)
    return keyed.dropDuplicatesWithinWatermark(["log_id", "template"]).drop("event_time")
