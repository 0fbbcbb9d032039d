"""Order-dependent columns over one log without sorting the log in one task.

A log is cut into buckets that follow its order (line ranges, minutes). Ordering work happens per (log, bucket); what
crosses a bucket edge is carried through a summary with one row per bucket. The summaries are the only frames windowed
by log alone, so the work in one task grows with the number of buckets of a log, never with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: list[str], bucket: str, order: list, name: str = "pos") -> DataFrame:
    """1-based position of every row within its keys (W9). ``bucket`` must not decrease along ``order``."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return (
        df.join(offsets, [*keys, bucket])
        .withColumn(name, (F.col("_offset") + local).cast("bigint"))
        .drop("_offset")
    )


def top(df: DataFrame, keys: list[str], order: list[Column], count: int | None) -> DataFrame:
    """The first ``count`` rows per key, all for None. Spark prunes to ``count`` rows per key in every task before it
    shuffles."""
    if count is None:
        return df
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= count).drop("_rank")
