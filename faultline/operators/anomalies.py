"""Statistical detectors over entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions import times
from faultline.operators import ordered
from faultline.operators.joins import attach
from faultline.schema import ANOMALIES, ERROR_LEVELS

COLUMNS = list(ANOMALIES)

#: Writes a frame under a name and reads it back, as ``Staging.table`` does.
Stage = Callable[[str, DataFrame], DataFrame]


def is_error() -> Column:
    """F1."""
    return F.col("level").isin(*ERROR_LEVELS)


def short_width(window: str) -> str:
    """``1 minute`` as ``1m``, ``6 hours`` as ``6h``."""
    number, unit = window.split()
    return f"{number}{unit[0]}"


def _start(width: str) -> Column:
    return F.window("ts", width).getField("start")


def error_rates(entries: DataFrame, cfg: Settings) -> DataFrame:
    """A1: errors and total per observed window; windows without entries do not appear."""
    timed = entries.filter(F.col("ts").isNotNull()).select(
        "log_id", _start(cfg.window).alias("window_start"), is_error().cast("int").alias("error")
    )
    counted = timed.groupBy("log_id", "window_start").agg(
        F.count(F.lit(1)).alias("total"), F.sum("error").alias("errors")
    )
    return counted.withColumn("rate", F.col("errors") / F.col("total"))


def rate_scores(entries: DataFrame, cfg: Settings) -> DataFrame:
    """Every window with its number, and its absolute z-score against all windows of its log.

    The frame windowed by log has one row per observed window, so a task's share is bounded by the time a log spans,
    not by its entries. A constant series has no z-score and never flags.
    """
    per_log = Window.partitionBy("log_id")
    spread = F.when(
        F.min("rate").over(per_log) < F.max("rate").over(per_log), F.stddev_pop("rate").over(per_log)
    )
    return error_rates(entries, cfg).select(
        "*",
        F.row_number().over(per_log.orderBy("window_start")).alias("number"),
        F.avg("rate").over(per_log).alias("mean"),
        spread.alias("spread"),
        F.count(F.lit(1)).over(per_log).alias("windows"),
        F.sum("total").over(per_log).alias("timed"),
    ).withColumn("z", F.abs((F.col("rate") - F.col("mean")) / F.col("spread")))


def _line_numbers(flagged: DataFrame, entries: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The first ``cap`` line numbers of every flagged window, without collecting whole windows."""
    lines = ordered.top(entries.join(flagged.select(*keys), keys, "left_semi"), keys, [F.col("line_number")], cap)
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list("line_number")).alias("affected_lines"))


def _windowed(entries: DataFrame, cfg: Settings) -> DataFrame:
    return entries.filter(F.col("ts").isNotNull()).select(
        "log_id", _start(cfg.window).alias("window_start"), "line_number", "level"
    )


def spike_windows(scored: DataFrame, cfg: Settings) -> DataFrame:
    """N1 without line lists."""
    return scored.filter(
        (F.col("timed") >= 5)
        & (F.col("windows") >= 3)
        & (F.col("z") > cfg.z_threshold)
        & (F.col("rate") > F.col("mean"))
        & (F.col("rate") > 0)
    )


def error_spikes(entries: DataFrame, cfg: Settings, stage: Stage | None = None, scored: DataFrame | None = None) -> DataFrame:
    """N1. With ``stage`` the flagged windows are a written table, whose size Spark knows before it joins entries."""
    flagged = spike_windows(rate_scores(entries, cfg) if scored is None else scored, cfg)
    flagged = stage("flagged_windows", flagged) if stage else flagged
    keys = ["log_id", "window_start"]
    lines = _line_numbers(flagged, _windowed(entries, cfg), keys, cfg.spike_line_cap)
    return flagged.join(lines, keys).select(
        "log_id",
        F.col("window_start").alias("ts"),
        F.lit("error_spike").alias("anomaly_type"),
        F.when(F.col("rate") > 0.5, "high").otherwise("medium").alias("severity"),
        F.format_string(
            f"Error rate spike in {short_width(cfg.window)} window: %.1f%% (z=%.2f)", F.col("rate") * 100, F.col("z")
        ).alias("description"),
        "affected_lines",
        F.col("z").alias("z_score"),
        F.col("mean").alias("baseline_value"),
        F.col("rate").alias("observed_value"),
    )


def latency_spikes(entries: DataFrame, cfg: Settings, stage: Stage | None = None) -> DataFrame:
    """One row per slow entry.

    With ``stage`` the figures of each log are a written table: a small one is broadcast by its measured size, and joined
    to a large one the entries of a hot log can be split by the adaptive skew join.
    """
    slow = entries.filter(F.col("response_time_ms") > 0).select("log_id", "line_number", "ts", "response_time_ms")
    value = F.col("response_time_ms")
    deviation = F.stddev_pop(value)
    stats = slow.groupBy("log_id").agg(
        F.avg(value).alias("mean"),
        F.when((F.min(value) == F.max(value)) | (deviation == 0), 1e-6).otherwise(deviation).alias("spread"),
        F.count(F.lit(1)).alias("samples"),
    )
    stats = stats.filter(F.col("samples") >= 10)
    scored = attach(slow, stage("latency_stats", stats) if stage else stats, cfg)
    scored = scored.withColumn("z", (value - F.col("mean")) / F.col("spread"))
    return scored.filter(F.col("z") > cfg.z_threshold).select(
        "log_id",
        "ts",
        F.lit("latency_spike").alias("anomaly_type"),
        F.lit("medium").alias("severity"),
        F.format_string(
            "High response time %.1fms (z=%.2f vs baseline %.1fms)", value, F.col("z"), F.col("mean")
        ).alias("description"),
        F.array("line_number").alias("affected_lines"),
        F.col("z").alias("z_score"),
        F.col("mean").alias("baseline_value"),
        value.alias("observed_value"),
    )


def gap_chunks(entries: DataFrame, cfg: Settings) -> DataFrame:
    """Positive gaps between neighbouring times, one row per log and time chunk.

    Entries are first reduced to distinct times. Gaps inside a chunk are summed up there, and only those longer than a
    minute are kept one by one, of which a chunk has room for few. The gap between a chunk and the one before it
    (``edge``) comes from their end points.
    """
    moments = (
        entries.filter(F.col("ts").isNotNull())
        .groupBy("log_id", _start(cfg.time_chunk).alias("chunk"), "ts")
        .agg(
            F.min("line_number").alias("line_after"),
            F.max("line_number").alias("last_line"),
            F.count(F.lit(1)).alias("timed"),
        )
    )
    inside = Window.partitionBy("log_id", "chunk").orderBy("ts")
    linked = moments.withColumn("previous_ts", F.lag("ts").over(inside)).withColumn(
        "line_before", F.lag("last_line").over(inside)
    )
    linked = linked.withColumn("gap", times.seconds_between(F.col("ts"), F.col("previous_ts")))
    kept = F.when(F.col("gap") > 60, F.struct("ts", "line_before", "line_after", "gap"))
    chunks = linked.groupBy("log_id", "chunk").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("line_after", "ts").alias("first_line"),
        F.max_by("last_line", "ts").alias("last_line"),
        F.sum("timed").alias("timed"),
        F.count("gap").alias("n"),
        F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("variance"),
        F.min("gap").alias("shortest"),
        F.max("gap").alias("longest"),
        F.collect_list(kept).alias("long_gaps"),
    )
    in_order = Window.partitionBy("log_id").orderBy("chunk")
    edge = F.struct(
        F.col("first_ts").alias("ts"),
        F.lag("last_line").over(in_order).alias("line_before"),
        F.col("first_line").alias("line_after"),
        times.seconds_between(F.col("first_ts"), F.lag("last_ts").over(in_order)).alias("gap"),
    )
    return chunks.withColumn("edge", edge)


def silence(entries: DataFrame, cfg: Settings) -> DataFrame:
    """N3. Chunk figures are merged per log; the rows windowed by log are bounded by the time a log spans."""
    per_log = Window.partitionBy("log_id")
    edge_gap = F.col("edge.gap")
    n = F.col("n") + F.when(edge_gap.isNotNull(), 1).otherwise(0)
    total = F.col("n") * F.col("mean") + F.coalesce(edge_gap, F.lit(0.0))
    merged = gap_chunks(entries, cfg).select(
        "*",
        F.sum(n).over(per_log).alias("n_gaps"),
        F.sum("timed").over(per_log).alias("n_timed"),
        F.try_divide(F.sum(total).over(per_log), F.sum(n).over(per_log)).alias("mu"),
        F.min(F.least("shortest", edge_gap)).over(per_log).alias("least"),
        F.max(F.greatest("longest", edge_gap)).over(per_log).alias("most"),
    )
    away = F.col("mean") - F.col("mu")
    squares = F.col("n") * (F.col("variance") + away * away)
    squares = squares + F.coalesce((edge_gap - F.col("mu")) * (edge_gap - F.col("mu")), F.lit(0.0))
    deviation = F.sqrt(F.try_divide(F.sum(squares).over(per_log), F.col("n_gaps")))
    merged = merged.withColumn(
        "spread", F.when((F.col("least") == F.col("most")) | (deviation == 0), 1e-6).otherwise(deviation)
    )
    candidates = F.concat(
        "long_gaps", F.when(edge_gap > 60, F.array("edge")).otherwise(F.slice(F.array("edge"), 1, 0))
    )
    mu, spread, gap = F.col("mu"), F.col("spread"), F.col("gap")
    long_gaps = (
        merged.filter((F.col("n_timed") >= 5) & (F.col("n_gaps") >= 3))
        .select("log_id", "mu", "spread", F.inline(candidates))
        .filter(gap > mu + 3 * spread)
    )
    return long_gaps.select(
        "log_id",
        "ts",
        F.lit("silence").alias("anomaly_type"),
        F.when(gap > mu + 5 * spread, "high").otherwise("medium").alias("severity"),
        F.format_string(
            "Log silence gap %.0fs (baseline ~%.0fs, threshold %.0fs)", gap, mu, mu + 3 * spread
        ).alias("description"),
        F.array("line_before", "line_after").alias("affected_lines"),
        ((gap - mu) / spread).alias("z_score"),
        mu.alias("baseline_value"),
        gap.alias("observed_value"),
    )


def cascade_runs(scored: DataFrame, cfg: Settings) -> DataFrame:
    """Flagged windows that stand in runs of three or more neighbouring observed windows."""
    base = F.when(F.col("mean") == 0, 1e-6).otherwise(F.col("mean"))
    flagged = scored.withColumn("mean", base).filter(
        (F.col("timed") >= 10)
        & (F.col("windows") >= 4)
        & (F.col("z") > cfg.z_threshold)
        & (F.col("rate") > F.col("mean") * 1.5)
    )
    # flagged windows only: a small share of the windows of a log
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy("number"))
    runs = flagged.withColumn("run", F.col("number") - rank)
    size = F.count(F.lit(1)).over(Window.partitionBy("log_id", "run"))
    return runs.withColumn("run_size", size).filter(F.col("run_size") >= 3)


def cascades(entries: DataFrame, cfg: Settings, stage: Stage | None = None, scored: DataFrame | None = None) -> DataFrame:
    """N4. ``stage`` as in ``error_spikes``."""
    windows = cascade_runs(rate_scores(entries, cfg) if scored is None else scored, cfg)
    windows = stage("cascade_windows", windows) if stage else windows
    runs = windows.groupBy("log_id", "run").agg(
        F.min("window_start").alias("ts"),
        F.count(F.lit(1)).alias("size"),
        F.max("z").alias("z_score"),
        F.first("mean").alias("baseline_value"),
        F.avg("rate").alias("observed_value"),
    )
    each = "minute" if short_width(cfg.window) == "1m" else short_width(cfg.window)
    errors = _windowed(entries.filter(is_error()), cfg)
    per_window = ordered.top(
        errors.join(windows.select("log_id", "window_start", "run"), ["log_id", "window_start"]),
        ["log_id", "window_start"],
        [F.col("line_number")],
        cfg.cascade_window_line_cap,
    )
    first = ordered.top(
        per_window, ["log_id", "run"], [F.col("window_start"), F.col("line_number")], cfg.cascade_line_cap
    )
    lines = first.groupBy("log_id", "run").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("window_start", "line_number"))), lambda r: r["line_number"]
        ).alias("affected_lines")
    )
    return runs.join(lines, ["log_id", "run"]).select(
        "log_id",
        "ts",
        F.lit("cascade_failure").alias("anomaly_type"),
        F.lit("critical").alias("severity"),
        F.format_string(f"Sustained elevated errors for %d consecutive {each} windows", "size").alias("description"),
        "affected_lines",
        "z_score",
        "baseline_value",
        "observed_value",
    )


def all_anomalies(entries: DataFrame, cfg: Settings, stage: Stage | None = None) -> DataFrame:
    """The rows of all four detectors; windows are scored once where ``stage`` can keep them."""
    scored = stage("window_scores", rate_scores(entries, cfg)) if stage else None
    found = [
        error_spikes(entries, cfg, stage, scored),
        latency_spikes(entries, cfg, stage),
        silence(entries, cfg),
        cascades(entries, cfg, stage, scored),
    ]
    return reduce(DataFrame.unionByName, [f.select(*COLUMNS) for f in found])


def order_keys() -> list[Column]:
    """Severity, time with unknown times first, detector, then line."""
    severity = F.col("severity")
    rank = F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)
    kind = F.col("anomaly_type")
    detector = (
        F.when(kind == "error_spike", 0).when(kind == "latency_spike", 1).when(kind == "silence", 2).otherwise(3)
    )
    return [rank, F.col("ts").asc_nulls_first(), detector, F.get("affected_lines", F.lit(0))]
