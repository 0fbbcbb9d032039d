"""Streaming error rates, spike flags and silence alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions import times
from faultline.operators.anomalies import is_error


def timed(entries: DataFrame, lateness: str) -> DataFrame:
    """Entries with a time, watermarked on it."""
    with_time = entries.filter(F.col("ts").isNotNull()).withColumn("event_time", times.as_instant(F.col("ts")))
    return with_time.withWatermark("event_time", lateness)


def error_rates(entries: DataFrame, cfg: Settings, lateness: str) -> DataFrame:
    """Errors and total per finished window; entries later than ``lateness`` are left out."""
    counted = timed(entries, lateness).groupBy("log_id", F.window("event_time", cfg.window)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_error()).alias("errors")
    )
    return counted.select(
        "log_id",
        times.from_instant(F.col("window.start")).alias("window_start"),
        "total",
        "errors",
        (F.col("errors") / F.col("total")).alias("rate"),
    )


def daily_moments(rates: DataFrame) -> DataFrame:
    """One row per log and day: number, mean and squares around the mean of the windows' rates. Such rows merge by sums."""
    days = rates.groupBy("log_id", F.to_date("window_start").alias("day"))
    return days.agg(F.count("rate").alias("n"), F.avg("rate").alias("mean"), (F.var_pop("rate") * F.count("rate")).alias("squares"))


def baseline(moments: DataFrame, earlier: DataFrame, rates: DataFrame, trailing: str) -> DataFrame:
    """Per log of ``rates``: mean and spread of the earlier windows within ``trailing`` before its oldest window.

    Whole days come from ``moments``; only the day in which the baseline begins is read window by window.
    """
    since = F.col("oldest") - F.expr(f"interval {trailing}")
    oldest = rates.groupBy("log_id").agg(F.min("window_start").alias("oldest")).withColumn("since", since)
    whole = moments.join(oldest, "log_id").filter(F.col("day") > F.to_date("since")).select("log_id", "n", "mean", "squares")
    past = earlier.select("log_id", F.col("window_start").alias("past"), F.col("rate").alias("past_rate"))
    near = (F.col("past") >= F.col("since")) & (F.to_date("past") == F.to_date("since")) & (F.col("past") < F.col("oldest"))
    begun = past.join(oldest, "log_id").filter(near).groupBy("log_id")
    begun = begun.agg(F.count("past_rate").alias("n"), F.avg("past_rate").alias("mean"), (F.var_pop("past_rate") * F.count("past_rate")).alias("squares"))
    both = whole.unionByName(begun).groupBy("log_id").agg(
        F.sum("n").alias("windows"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum(F.col("squares") + F.col("n") * F.col("mean") * F.col("mean")).alias("power"),
    )
    left = F.col("power") / F.col("windows") - F.col("mean") * F.col("mean")
    # rates lie in 0..1: what rounding leaves of equal ones is no spread
    spread = F.sqrt(F.when(left > 1e-12, left).otherwise(0.0))
    return both.select("log_id", "mean", spread.alias("spread"), "windows")


def flag_against(rates: DataFrame, stats: DataFrame, cfg: Settings) -> DataFrame:
    """Windows whose rate stands out from the baseline of their log."""
    z = (F.col("rate") - F.col("mean")) / F.when(F.col("spread") > 0, F.col("spread"))
    return (
        rates.join(stats.filter(F.col("windows") >= 3), "log_id")
        .withColumn("z_score", z)
        .filter((F.col("z_score") > cfg.z_threshold) & (F.col("rate") > 0))
    )


class SpikeFlags:
    """X3 as a ``foreachBatch`` function: flags each batch of finished windows against the trailing ones on disk.

    Each batch writes to folders named after its id and reads only batches before it, so a batch that is run again
    gives the same rows in the same places. Windows are stored by day, and also as one row of moments per log and day; a
    batch reads moments of the days that its baseline covers, and windows only of the days in which it begins. The
    trailing baseline stands in for the whole log, which a stream never sees; this is an approximation of N1.
    """

    COLUMNS = ["log_id", "window_start", "total", "errors", "rate"]
    SCHEMA = "log_id string, window_start timestamp_ntz, total bigint, errors bigint, rate double, batch bigint, day date"
    MOMENTS = "log_id string, day date, n bigint, mean double, squares double, batch bigint"

    def __init__(self, spark: SparkSession, folder: str, cfg: Settings, trailing: str = "1 day"):
        self.windows = f"{folder.rstrip('/')}/windows"
        self.moments = f"{folder.rstrip('/')}/moments"
        self.flags = f"{folder.rstrip('/')}/flags"
        self.cfg, self.trailing = cfg, trailing
        # an empty first batch gives the table a folder to be read from
        nothing = spark.createDataFrame([], self.SCHEMA).drop("batch", "day")
        nothing.write.mode("overwrite").parquet(f"{self.windows}/batch=-1/day=1970-01-01")
        spark.createDataFrame([], self.MOMENTS).drop("batch").write.mode("overwrite").parquet(f"{self.moments}/batch=-1")

    def __call__(self, rates: DataFrame, batch: int) -> None:
        spark = rates.sparkSession
        # written first, so that the stream's plan runs once
        dated = rates.select(*self.COLUMNS, F.lit(batch).cast("bigint").alias("batch"), F.to_date("window_start").alias("day"))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(self.windows)
        known = spark.read.schema(self.SCHEMA).option("basePath", self.windows).parquet(self.windows)
        own = known.filter(F.col("batch") == batch).select(*self.COLUMNS)
        daily_moments(own).write.mode("overwrite").parquet(f"{self.moments}/batch={batch}")
        start = F.expr(f"interval {self.trailing}")
        first, last = own.agg(F.to_date(F.min("window_start") - start), F.to_date(F.max("window_start") - start)).head()
        earlier = known.filter(F.col("batch") < batch)
        moments = spark.read.schema(self.MOMENTS).option("basePath", self.moments).parquet(self.moments).filter(F.col("batch") < batch)
        if first is not None:
            earlier = earlier.filter(F.col("day").between(F.lit(first), F.lit(last)))
            moments = moments.filter(F.col("day") > F.lit(first))
        flagged = flag_against(own, baseline(moments, earlier, own, self.trailing), self.cfg)
        flagged.write.mode("overwrite").parquet(f"{self.flags}/batch={batch}")

    def found(self, spark: SparkSession) -> DataFrame:
        """All windows flagged so far."""
        return spark.read.option("basePath", self.flags).parquet(self.flags)


def silence_alarms(entries: DataFrame, gap_seconds: int, lateness: str) -> DataFrame:
    """The end of every burst of entries that was followed by at least ``gap_seconds`` of silence."""
    bursts = timed(entries, lateness).groupBy(
        "log_id", F.session_window("event_time", f"{gap_seconds} seconds")
    ).agg(
        F.min("ts").alias("active_from"), F.max("ts").alias("silent_since"), F.count(F.lit(1)).alias("entries")
    )
    return bursts.select("log_id", "active_from", "silent_since", "entries")
