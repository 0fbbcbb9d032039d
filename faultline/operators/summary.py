"""Per-log figures and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.operators import ordered
from faultline.operators.anomalies import is_error


def line_totals(lines: DataFrame) -> DataFrame:
    """A3."""
    return lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_lines"))


def entry_stats(entries: DataFrame) -> DataFrame:
    """A2-A4."""
    parsed = F.count(F.lit(1))
    return entries.groupBy("log_id").agg(
        parsed.alias("parsed_lines"),
        F.struct(F.min("ts").alias("start"), F.max("ts").alias("end")).alias("time_range"),
        (F.count_if(is_error()) / parsed).alias("error_rate"),
        (F.count_if(F.col("level") == "WARNING") / parsed).alias("warning_rate"),
        F.count_if(F.col("level") == "CRITICAL").alias("critical_count"),
    )


def top_errors(entries: DataFrame, count: int = 5) -> DataFrame:
    """A5: the most frequent error messages of each log, ties by first appearance (``pos`` from 1)."""
    messages = entries.filter(is_error()).groupBy("log_id", "message").agg(
        F.count(F.lit(1)).alias("count"), F.min("line_number").alias("first_line")
    )
    return ordered.top(messages, ["log_id"], [F.col("count").desc(), F.col("first_line")], count)


def top_error_messages(entries: DataFrame, count: int = 5) -> DataFrame:
    ranked = F.struct((-F.col("count")).alias("order"), "first_line", "message")
    return top_errors(entries, count).groupBy("log_id").agg(
        F.transform(F.array_sort(F.collect_list(ranked)), lambda r: r["message"]).alias("top_error_messages")
    )


def log_summary(
    entries: DataFrame,
    cfg: Settings,
    lines: DataFrame | None = None,
    formats: DataFrame | None = None,
    skipped: DataFrame | None = None,
    logs: DataFrame | None = None,
) -> DataFrame:
    """One row per log. Without ``lines`` every entry counts as one line; ``logs`` adds logs without lines.

    Line counts come from ``formats`` where detection has left them there, else from ``lines``.
    """
    stats = entry_stats(entries)
    out = stats if logs is None else logs.select("log_id").join(stats, "log_id", "left")
    if lines is not None:
        counted = formats is not None and "total_lines" in formats.columns
        totals = formats.select("log_id", "total_lines") if counted else line_totals(lines)
        # logs whose lines were all skipped have totals but no entries
        out = out.join(totals, "log_id", "left" if logs is not None else "full")
    else:
        out = out.withColumn("total_lines", F.col("parsed_lines"))
    out = out.join(formats.select("log_id", "log_source"), "log_id", "left") if formats is not None else (
        out.withColumn("log_source", F.lit("unknown"))
    )
    if skipped is not None:
        out = out.join(skipped, "log_id", "left")
    else:
        out = out.withColumn("skipped_lines", F.lit(0).cast("bigint"))
    out = out.join(top_error_messages(entries), "log_id", "left")

    def filled(name: str, value):
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    unknown = F.struct(
        F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end")
    )
    return out.select(
        "log_id",
        filled("log_source", "unknown"),
        filled("total_lines", 0),
        filled("parsed_lines", 0),
        filled("skipped_lines", 0),
        F.coalesce("time_range", unknown).alias("time_range"),
        filled("error_rate", 0.0),
        filled("warning_rate", 0.0),
        filled("critical_count", 0),
        F.coalesce("top_error_messages", F.array().cast("array<string>")).alias("top_error_messages"),
        F.lit(cfg.version).alias("pipeline_version"),
    )


def grade(summary: DataFrame, anomalies: DataFrame, root_causes: DataFrame) -> DataFrame:
    """V1: adds ``severity`` P1-P4 to a summary."""
    kinds = anomalies.groupBy("log_id").agg(
        F.bool_or(F.col("anomaly_type") == "cascade_failure").alias("cascade"), F.lit(True).alias("anomalous")
    )
    certain = root_causes.groupBy("log_id").agg(F.bool_or(F.col("confidence") == "high").alias("certain"))
    joined = summary.join(kinds, "log_id", "left").join(certain, "log_id", "left")

    def has(name):
        return F.coalesce(F.col(name), F.lit(False))

    severity = (
        F.when((F.col("critical_count") > 0) & has("certain"), "P1")
        .when((F.col("error_rate") > 0.1) | has("cascade"), "P2")
        .when((F.col("error_rate") > 0.02) | has("anomalous"), "P3")
        .otherwise("P4")
    )
    return joined.withColumn("severity", severity).drop("cascade", "anomalous", "certain")


def level_distribution(summary: DataFrame) -> DataFrame:
    """Shares by level, for logs whose timeline has no times."""
    info = F.greatest(F.lit(0.0), 1 - F.col("error_rate") - F.col("warning_rate"))
    shares = F.array(
        F.struct(F.lit("INFO").alias("level"), info.alias("share")),
        F.struct(F.lit("WARN").alias("level"), F.col("warning_rate").alias("share")),
        F.struct(F.lit("ERROR").alias("level"), F.col("error_rate").alias("share")),
    )
    return summary.select("log_id", F.inline(shares))
