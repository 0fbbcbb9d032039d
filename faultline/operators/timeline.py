"""Chronological timeline of notable events per log."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.config import Settings
from faultline.functions.text import contains_any, first_chars
from faultline.operators import ordered
from faultline.operators.anomalies import is_error, order_keys

EVENT = ["log_id", "ts", "event_type", "description", "severity", "related_entries"]
# Fixed value: how many timed entries before an INFO entry may hold the error it recovers from.
RECOVERY_REACH = 5
# events of equal time keep the order in which they are emitted
TIES = ["stage", "tie_1", "tie_2", "tie_3"]


def _message() -> Column:
    return F.coalesce("message", F.lit(""))


def first_errors(entries: DataFrame) -> DataFrame:
    """The first error per log and message start."""
    errors = entries.filter(is_error()).select(
        "log_id",
        first_chars(_message(), 120).alias("key"),
        F.struct("line_number", "ts", "level", first_chars(_message(), 500).alias("description")).alias("row"),
    )
    firsts = errors.groupBy("log_id", "key").agg(F.min("row").alias("row"))
    return firsts.select(
        "log_id",
        F.col("row.ts").alias("ts"),
        F.lit("first_error").alias("event_type"),
        F.col("row.description").alias("description"),
        F.when(F.col("row.level") == "CRITICAL", "high").otherwise("medium").alias("severity"),
        F.array("row.line_number").alias("related_entries"),
        F.lit(0).alias("stage"),
        F.col("row.line_number").alias("tie_1"),
        F.lit(0).cast("bigint").alias("tie_2"),
        F.lit(0).cast("bigint").alias("tie_3"),
    )


def entry_events(entries: DataFrame) -> DataFrame:
    """Events that need nothing but their own entry; one entry may give several."""
    lowered = F.lower(_message())
    kinds = [
        (F.col("level") == "CRITICAL", "critical", 500, "critical"),
        (contains_any(lowered, fixed.RESTART_WORDS), "service_restart", 400, "low"),
        (contains_any(lowered, fixed.RESOURCE_WORDS), "resource", 400, "critical"),
    ]
    made = F.array(
        *[
            F.when(
                condition,
                F.struct(
                    F.lit(kind).alias("event_type"),
                    first_chars(_message(), size).alias("description"),
                    F.lit(severity).alias("severity"),
                    F.lit(i).cast("bigint").alias("tie_2"),
                ),
            )
            for i, (condition, kind, size, severity) in enumerate(kinds, 1)
        ]
    )
    any_kind = reduce(Column.__or__, [condition for condition, *_ in kinds])
    rows = entries.filter(any_kind).select("log_id", "ts", "line_number", F.explode(F.array_compact(made)).alias("e"))
    return rows.select(
        "log_id",
        "ts",
        "e.event_type",
        "e.description",
        "e.severity",
        F.array("line_number").alias("related_entries"),
        F.lit(0).alias("stage"),
        F.col("line_number").alias("tie_1"),
        "e.tie_2",
        F.lit(0).cast("bigint").alias("tie_3"),
    )


def anomaly_events(anomalies: DataFrame, cfg: Settings) -> DataFrame:
    """T5."""
    severity, _, detector, line = order_keys()
    return anomalies.select(
        "log_id",
        "ts",
        F.lit("anomaly").alias("event_type"),
        "description",
        "severity",
        F.slice("affected_lines", 1, cfg.timeline_line_cap).alias("related_entries"),
        F.lit(1).alias("stage"),
        severity.cast("bigint").alias("tie_1"),
        detector.cast("bigint").alias("tie_2"),
        line.cast("bigint").alias("tie_3"),
    )


def recoveries(entries: DataFrame, cfg: Settings) -> DataFrame:
    """The first INFO entry of each log that has an error among the five timed entries before it.

    Each (log, tick) is put in order on its own and reduced to one row: its size, its last error, its first hit and its
    first five entries. Errors of earlier ticks can only matter to those five. Ticks are added up inside their time
    chunk, and only chunks are windowed by log, so a hot ten minutes is the work of many tasks.
    """
    start = F.window("ts", cfg.time_chunk).getField("start")
    timed = entries.filter(F.col("ts").isNotNull()).select(
        "log_id",
        start.alias("chunk"),
        F.date_trunc("second", "ts").alias("tick"),
        "ts",
        "line_number",
        is_error().alias("error"),
        (F.col("level") == "INFO").alias("info"),
    )
    inside = Window.partitionBy("log_id", "chunk", "tick").orderBy("ts", "line_number")
    numbered = timed.withColumn("place", F.row_number().over(inside))
    numbered = numbered.withColumn("error_at", F.when(F.col("error"), F.col("place")))
    last_error = F.max("error_at").over(inside.rowsBetween(-RECOVERY_REACH, -1))
    numbered = numbered.withColumn("hit", F.col("info") & last_error.isNotNull())
    entry = F.struct("ts", "line_number")
    ticks = numbered.groupBy("log_id", "chunk", "tick").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("error_at").alias("error_at"),
        F.min(F.when(F.col("hit"), entry)).alias("own"),
        F.collect_list(
            F.when(F.col("info") & (F.col("place") <= RECOVERY_REACH), F.struct("place", "ts", "line_number"))
        ).alias("head"),
    )

    def before(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    earlier_ticks = before("log_id", "chunk", order="tick")
    ticks = ticks.withColumn("offset", F.coalesce(F.sum("size").over(earlier_ticks), F.lit(0)))
    ticks = ticks.withColumn("error_at", F.col("offset") + F.col("error_at"))
    ticks = ticks.withColumn("in_chunk", F.max("error_at").over(earlier_ticks))
    chunks = ticks.groupBy("log_id", "chunk").agg(F.sum("size").alias("size"), F.max("error_at").alias("error_at"))
    earlier = before("log_id", order="chunk")
    chunks = chunks.withColumn("rows_before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    chunks = chunks.withColumn("carried", F.max(F.col("rows_before") + F.col("error_at")).over(earlier))
    joined = ticks.join(chunks.select("log_id", "chunk", "rows_before", "carried"), ["log_id", "chunk"])
    # places of the tick's first entries and of the last error before it, both counted in the whole log
    last = F.greatest("carried", F.col("rows_before") + F.col("in_chunk"))
    near = F.filter("head", lambda h: F.col("rows_before") + F.col("offset") + h["place"] - last <= RECOVERY_REACH)
    over_edge = F.array_min(F.transform(near, lambda h: F.struct(h["ts"].alias("ts"), h["line_number"].alias("line_number"))))
    first = joined.groupBy("log_id").agg(F.min(F.least("own", over_edge)).alias("first"))
    return first.filter(F.col("first").isNotNull()).select("log_id", "first.ts", "first.line_number")


def recovery_events(entries: DataFrame, cfg: Settings) -> DataFrame:
    message = entries.filter(F.col("level") == "INFO").select(
        "log_id", "line_number", first_chars(_message(), 300).alias("text")
    )
    found = recoveries(entries, cfg).join(message, ["log_id", "line_number"])
    return found.select(
        "log_id",
        "ts",
        F.lit("recovery").alias("event_type"),
        F.concat(F.lit("Possible recovery: "), "text").alias("description"),
        F.lit("low").alias("severity"),
        F.array("line_number").alias("related_entries"),
        F.lit(2).alias("stage"),
        *[F.lit(0).cast("bigint").alias(tie) for tie in TIES[1:]],
    )


def events(entries: DataFrame, anomalies: DataFrame, cfg: Settings) -> DataFrame:
    """Every event, uncut."""
    parts = [
        first_errors(entries),
        entry_events(entries),
        anomaly_events(anomalies, cfg),
        recovery_events(entries, cfg),
    ]
    return reduce(DataFrame.unionByName, [p.select(*EVENT, *TIES) for p in parts])


def build(
    entries: DataFrame,
    anomalies: DataFrame,
    cfg: Settings,
    stage: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Events by time, unknown times first; longer timelines keep their two ends. ``pos`` counts from 1.

    ``timeline_cap`` None keeps every event. The two ends are taken from the same events; ``stage`` writes those once,
    so that the emitters run once.
    """
    every = events(entries, anomalies, cfg)
    if stage is not None:
        every = stage("timeline_events", every)
    if cfg.timeline_cap is None:
        known = F.coalesce("ts", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
        every = every.withColumn("chunk", F.window(known, cfg.time_chunk).getField("start"))
        order = [F.col("ts").asc_nulls_first(), *TIES]
        return ordered.positions(every, ["log_id"], "chunk", order).select("log_id", "pos", *EVENT[1:])
    cap, head_size = cfg.timeline_cap, cfg.timeline_cap // 2
    forward = [F.col("ts").asc_nulls_first(), *[F.col(t).asc() for t in TIES]]
    backward = [F.col("ts").desc_nulls_last(), *[F.col(t).desc() for t in TIES]]
    head = ordered.top(every, ["log_id"], forward, cap).withColumn("tail", F.lit(False))
    tail = ordered.top(every, ["log_id"], backward, cap - head_size).withColumn("tail", F.lit(True))
    # at most two caps of rows per log from here on
    per_log = Window.partitionBy("log_id")
    ends = head.unionByName(tail).withColumn(
        "head_rows", F.sum(F.when(F.col("tail"), 0).otherwise(1)).over(per_log)
    )
    ends = ends.withColumn("nth", F.row_number().over(Window.partitionBy("log_id", "tail").orderBy(*forward)))
    uncut = F.col("head_rows") < cap
    kept = ends.filter((uncut & ~F.col("tail")) | (~uncut & (F.col("tail") | (F.col("nth") <= head_size))))
    position = F.row_number().over(per_log.orderBy(F.col("tail"), *forward))
    return kept.withColumn("pos", position.cast("bigint")).select("log_id", "pos", *EVENT[1:])


def volume(timeline: DataFrame) -> DataFrame:
    """Timeline events per minute by severity band."""
    severity = F.lower(F.coalesce("severity", F.lit("")))
    serious = severity.isin("critical", "high")
    medium = severity == "medium"
    rows = timeline.filter(F.col("ts").isNotNull()).select(
        "log_id",
        F.window("ts", "1 minute").getField("start").alias("minute"),
        serious.cast("bigint").alias("serious"),
        medium.cast("bigint").alias("medium"),
    )
    return rows.groupBy("log_id", "minute").agg(
        F.sum(1 - F.col("serious") - F.col("medium")).alias("info"),
        F.sum("medium").alias("warning"),
        F.sum("serious").alias("error"),
        F.count(F.lit(1)).alias("total"),
    )
