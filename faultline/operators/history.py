"""Operations over the table of past analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.schema import HISTORY

# Weight of each severity and the lower bounds of the average.
WEIGHTS = {"P1": 4, "P2": 3, "P3": 2, "P4": 1}
BOUNDS = (("P1", 3.5), ("P2", 2.5), ("P3", 1.5))


def entries_of(graded: DataFrame, anomalies: DataFrame, clusters: DataFrame, cfg: Settings) -> DataFrame:
    """One history row per analysed log."""
    counts = graded.join(anomalies.groupBy("log_id").agg(F.count(F.lit(1)).alias("a")), "log_id", "left").join(
        clusters.groupBy("log_id").agg(F.count(F.lit(1)).alias("c")), "log_id", "left"
    )
    title = F.concat(
        F.col("log_source"), F.lit(" analysis — "), F.col("severity"), F.lit(" ("), F.col("total_lines"),
        F.lit(" lines)"),
    )
    return counts.select(
        F.col("log_id").alias("id"),
        cfg.now().alias("ts"),
        title.alias("title"),
        "severity",
        "log_source",
        "total_lines",
        F.coalesce("c", F.lit(0)).alias("cluster_count"),
        F.coalesce("a", F.lit(0)).alias("anomaly_count"),
        F.lit(False).alias("bookmarked"),
    )


def append(history: DataFrame, new: DataFrame, cfg: Settings) -> DataFrame:
    """The newest rows of both, newest first."""
    columns = list(HISTORY)
    both = history.select(*columns).unionByName(new.select(*columns))
    both = both.orderBy(F.col("ts").desc(), "id")
    return both if cfg.listing_rows is None else both.limit(cfg.listing_rows)


def search(history: DataFrame, text: str = "", severity: str | None = None, bookmarked: bool = False) -> DataFrame:
    """F8."""
    if bookmarked:
        history = history.filter("bookmarked")
    if severity:
        history = history.filter(F.col("severity") == severity)
    if text:
        wanted = text.lower()
        hit = F.lit(False)
        for column in ("title", "log_source", "severity"):
            hit = hit | F.lower(column).contains(wanted)
        history = history.filter(hit)
    return history


def by_severity(history: DataFrame) -> DataFrame:
    """A12."""
    return history.groupBy("severity").agg(F.count(F.lit(1)).alias("analyses"))


def by_source(history: DataFrame) -> DataFrame:
    """Most frequent first."""
    counts = history.groupBy("log_source").agg(F.count(F.lit(1)).alias("analyses"))
    return counts.orderBy(F.col("analyses").desc(), "log_source")


def totals(history: DataFrame) -> DataFrame:
    """A12."""
    return history.agg(
        F.count(F.lit(1)).alias("analyses"),
        F.sum("total_lines").alias("total_lines"),
        F.sum("cluster_count").alias("clusters"),
        F.sum("anomaly_count").alias("anomalies"),
        F.max("ts").alias("last_analysis"),
    )


def daily(history: DataFrame) -> DataFrame:
    """A13."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return (
        history.groupBy(day)
        .agg(F.count(F.lit(1)).alias("analyses"), F.count_if(F.col("severity").isin("P1", "P2")).alias("serious"))
        .orderBy("day")
    )


def _weight(severity: Column) -> Column:
    chain = F
    for name, weight in WEIGHTS.items():
        chain = chain.when(severity == name, weight)
    return chain.otherwise(1)


def average_severity(history: DataFrame) -> DataFrame:
    """One row; a dash when there is no history."""
    average = F.col("average")
    grade = F.when(average.isNull(), "—")
    for name, bound in BOUNDS:
        grade = grade.when(average >= bound, name)
    return history.agg(F.avg(_weight(F.col("severity"))).alias("average")).select(
        "average", grade.otherwise("P4").alias("severity")
    )


def service_metrics(runs: DataFrame, cfg: Settings) -> DataFrame:
    """Request count, mean time and requests per format, from rows with ``log_source, processing_time_ms``."""
    per_source = runs.groupBy("log_source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("processing_time_ms").alias("ms")
    )
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
        (F.coalesce(F.sum("ms"), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias(
            "avg_processing_time_ms"
        ),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("log_source", "n")))).alias("format_distribution"),
        F.lit(cfg.version).alias("prompt_version"),
    )
