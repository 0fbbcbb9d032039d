"""Traceback merging (P12, W8): which lines belong to which traceback, without walking the log line by line.

Rules, per log in line order. A line is a *breaker* if it is not blank and starts with neither space nor tab. The
*open header* at a line is the first traceback header since the last breaker, that breaker included. A non-breaker line
belongs to the open header, if there is one. A breaker opens its own block if it is a header; else it belongs to the
block that was open on the line before, provided it looks like ``Name: text``; else it stands alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.config import Settings
from faultline.functions.text import first_chars, lstrip, pattern, rstrip, strip


def _flagged(lines: DataFrame, cfg: Settings) -> DataFrame:
    raw = F.col("raw_line")
    blank = strip(raw) == ""
    breaker = ~blank & ~raw.startswith(" ") & ~raw.startswith("\t")
    return lines.select(
        "log_id",
        "line_number",
        "raw_line",
        F.floor(F.col("line_number") / cfg.chunk_lines).alias("chunk"),
        blank.alias("blank"),
        breaker.alias("breaker"),
        strip(raw).startswith(fixed.TRACEBACK_HEADER).alias("header"),
        (breaker & lstrip(raw).rlike(pattern(fixed.TRACEBACK_CLOSING))).alias("closing"),
    )


def _open_chunks(flagged: DataFrame) -> DataFrame:
    """Chunks that hold a header or start inside a block, with the header still open at their start."""
    line = F.col("line_number")
    chunks = flagged.groupBy("log_id", "chunk").agg(
        F.max(F.when(F.col("breaker"), line)).alias("last_breaker"),
        # at most one number per line of a chunk
        F.collect_list(F.when(F.col("header"), line)).alias("headers"),
    )
    after_last = F.filter("headers", lambda h: h >= F.coalesce(F.col("last_breaker"), F.lit(0)))
    chunks = chunks.select(
        "log_id",
        "chunk",
        "last_breaker",
        (F.size("headers") > 0).alias("has_header"),
        F.array_min(after_last).alias("tail_header"),
    )
    in_order = Window.partitionBy("log_id").orderBy("chunk")
    stretch = F.count("last_breaker").over(in_order)
    still_open = F.min("tail_header").over(Window.partitionBy("log_id", "stretch").orderBy("chunk"))
    return (
        chunks.withColumn("stretch", stretch)
        .withColumn("open", still_open)
        .select("log_id", "chunk", "has_header", F.lag("open").over(in_order).alias("carried"))
        .filter(F.col("carried").isNotNull() | F.col("has_header"))
        .drop("has_header")
    )


def assign(lines: DataFrame, cfg: Settings, stage: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``block``: line number of the header a line belongs to, NULL for lines outside tracebacks.

    Only chunks that touch a traceback are put in order. ``stage`` writes the table of those chunks, one short row
    per chunk, and reads it back; with its size known Spark broadcasts it when it is small, and then the lines of all
    other chunks are not shuffled at all.
    """
    flagged = _flagged(lines, cfg)
    chunks = _open_chunks(flagged)
    if stage is not None:
        chunks = stage("traceback_chunks", chunks)
    marked = flagged.join(chunks, ["log_id", "chunk"])
    in_order = Window.partitionBy("log_id", "chunk").orderBy("line_number")
    since_breaker = Window.partitionBy("log_id", "chunk", "stretch").orderBy("line_number")
    line = F.col("line_number")
    first_header = F.min(F.when(F.col("header"), line)).over(since_breaker)
    open_header = F.when(F.col("stretch") == 0, F.coalesce("carried", first_header)).otherwise(first_header)
    open_before = F.when(F.row_number().over(in_order) == 1, F.col("carried")).otherwise(
        F.lag("open").over(in_order)
    )
    block = (
        F.when(~F.col("breaker"), F.col("open"))
        .when(F.col("header"), line)
        .when(F.col("closing"), F.col("open_before"))
    )
    columns = ["log_id", "line_number", "raw_line", "blank"]
    touched = (
        marked.withColumn("stretch", F.count(F.when(F.col("breaker"), 1)).over(in_order))
        .withColumn("open", open_header)
        .withColumn("open_before", open_before)
        .select(*columns, block.alias("block"))
    )
    others = flagged.join(chunks.select("log_id", "chunk"), ["log_id", "chunk"], "left_anti")
    return touched.unionByName(others.select(*columns, F.lit(None).cast("bigint").alias("block")))


def merged(assigned: DataFrame) -> DataFrame:
    """One row per traceback: the header's line, the joined block and its last line as the message."""
    header = F.col("line_number") == F.col("block")
    body = F.when(header, rstrip(F.col("raw_line"))).otherwise(F.col("raw_line"))
    rows = assigned.filter(F.col("block").isNotNull()).select(
        "log_id",
        "block",
        # the raw line is wanted of the header alone
        F.struct("line_number", body.alias("body"), F.when(header, F.col("raw_line")).alias("raw_line")).alias("row"),
    )
    blocks = rows.groupBy("log_id", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    last = F.element_at("rows", -1)
    return blocks.select(
        "log_id",
        F.col("block").alias("line_number"),
        F.get("rows", F.lit(0))["raw_line"].alias("raw_line"),
        first_chars(last["body"], 500).alias("message"),
        F.array_join(F.transform("rows", lambda r: r["body"]), "\n").alias("stack_trace"),
    )


def singles(assigned: DataFrame) -> DataFrame:
    """The non-blank lines outside tracebacks."""
    return assigned.filter(F.col("block").isNull() & ~F.col("blank")).select("log_id", "line_number", "raw_line")
