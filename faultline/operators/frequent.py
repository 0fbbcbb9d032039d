"""The most frequent messages of each log in two passes (A5): sums by hash bucket, then exact counts where they can matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import ordered, summary
from faultline.operators.anomalies import is_error

#: Hash buckets per log, and buckets counted first for each place asked for.
BUCKETS = 65_536
FIRST = 4
#: Most (log, bucket) rows, each a short key, that are broadcast; with more, every message is counted in one aggregate.
MOST_KEYS = 200_000

Stage = Callable[[str, DataFrame], DataFrame]


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("message"), F.lit(buckets)).alias("bucket")


def sketch(errors: DataFrame) -> DataFrame:
    """log_id, bucket, n: a sum per hash bucket, which merges by addition and bounds the count of each message in it."""
    return errors.groupBy("log_id", "bucket").agg(F.count(F.lit(1)).alias("n"))


def within(errors: DataFrame, keys: DataFrame) -> DataFrame:
    """The errors in the buckets ``keys``, of which there are at most MOST_KEYS: rows of other buckets are never shuffled."""
    return errors.join(F.broadcast(keys), ["log_id", "bucket"], "left_semi")


def counted(errors: DataFrame) -> DataFrame:
    return errors.groupBy("log_id", "message").agg(F.count(F.lit(1)).alias("count"), F.min("line_number").alias("first_line"))


def leading(messages: DataFrame, count: int) -> DataFrame:
    return ordered.top(messages, ["log_id"], [F.col("count").desc(), F.col("first_line")], count)


def top_errors(entries: DataFrame, stage: Stage, count: int = 5, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``summary.top_errors``, without a shuffle of messages too rare to be among them.

    The fullest buckets of each log are counted exactly first. The count in last place there is one that ``count``
    messages reach, so every message that belongs to the result lies in a bucket with at least that sum: these are
    counted in the second pass, others can hold none, ties included. Where a log has too few messages in its fullest
    buckets, all its buckets are counted. Meant for logs with very many different messages; the answer is exact whatever
    the hash does. Null messages are one message. No entries give no rows.
    """
    errors = entries.filter(is_error()).select("log_id", "message", "line_number", "level", bucket(buckets))
    sums = stage("message_sums", sketch(errors))
    fullest = ordered.top(sums, ["log_id"], [F.col("n").desc(), F.col("bucket")], FIRST * count)
    fullest = stage("fullest_buckets", fullest.select("log_id", "bucket"))
    if fullest.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        return summary.top_errors(entries, count)
    head = leading(counted(within(errors, fullest)), count)
    reached = head.groupBy("log_id").agg(F.when(F.count(F.lit(1)) >= count, F.min("count")).otherwise(0).alias("least"))
    needed = sums.join(reached, "log_id").where(F.col("n") >= F.col("least")).select("log_id", "bucket")
    needed = stage("needed_buckets", needed)
    if needed.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        return summary.top_errors(entries, count)
    return leading(counted(within(errors, needed)), count)
