"""Markdown, JSON and prompt texts, one row per log (V2-V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.config import Settings
from faultline.functions import times
from faultline.functions.text import first_chars, strip
from faultline.operators import ordered
from faultline.operators.anomalies import order_keys

CAUSE = ["hypothesis", "confidence", "evidence", "category", "first_signal_at", "recommended_actions"]
ANOMALY = [
    "ts", "anomaly_type", "severity", "description", "affected_lines", "z_score", "baseline_value", "observed_value",
]
CLUSTER = [
    "cluster_id", "representative_message", "count", "first_seen", "last_seen", "severity", "sample_messages",
    "affected_services",
]
EVENT = ["ts", "event_type", "description", "severity", "related_entries"]


def _in_order(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows of a per-log bounded table as one array per log, by ``pos``."""
    packed = rows.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias(name))
    return packed


def _first_anomalies(anomalies: DataFrame, count: int | None) -> DataFrame:
    first = ordered.top(anomalies, ["log_id"], order_keys(), count)
    position = F.row_number().over(Window.partitionBy("log_id").orderBy(*order_keys()))
    return first.withColumn("pos", position.cast("bigint"))


def findings(
    summary: DataFrame,
    anomalies: DataFrame,
    clusters: DataFrame,
    timeline: DataFrame,
    root_causes: DataFrame,
    cfg: Settings,
) -> DataFrame:
    """The summary with the four child tables as ordered arrays.

    Clusters, timeline and root causes have a fixed upper size per log. Anomalies do not: their first
    ``report_inline_rows`` go in here (None: all), with their number in ``anomalies_total``, and the rest into
    ``continuations`` and ``prompt_continuations``.
    """
    parts = [
        _in_order(root_causes, CAUSE, "root_causes"),
        _in_order(_first_anomalies(anomalies, cfg.report_inline_rows), ANOMALY, "anomalies"),
        _in_order(clusters, CLUSTER, "error_clusters"),
        _in_order(timeline, EVENT, "timeline"),
    ]
    out = summary
    for part in parts:
        out = out.join(part, "log_id", "left")
    totals = anomalies.groupBy("log_id").agg(F.count(F.lit(1)).alias("anomalies_total"))
    return out.join(totals, "log_id", "left").withColumn("anomalies_total", F.coalesce("anomalies_total", F.lit(0)))


def _lines(items: Column, to_text, limit: int | None, when_empty: str) -> Column:
    shown = items if limit is None else F.slice(items, 1, limit)
    text = F.array_join(F.transform(shown, to_text), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, text).otherwise(F.lit(when_empty))


def _percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def _time_range(unknown: str = "unknown") -> Column:
    start, end = F.col("time_range.start"), F.col("time_range.end")
    shown = F.concat(times.spaced(start, "None"), F.lit(" → "), times.spaced(end, "None"))
    return F.when(start.isNull() & end.isNull(), unknown).otherwise(shown)


def _processing_ms(found: DataFrame) -> Column:
    return F.col("processing_time_ms") if "processing_time_ms" in found.columns else F.lit(0.0)


def body(found: DataFrame) -> Column:
    """V2: the six sections."""
    causes = _lines(
        F.col("root_causes"),
        lambda r: F.concat(
            F.lit("- **"), r["category"], F.lit("** ("), r["confidence"], F.lit("): "), r["hypothesis"],
            F.lit("\n  - Evidence: "), F.array_join(F.slice(r["evidence"], 1, 3), ", "),
        ),
        None,
        fixed.NO_ROOT_CAUSE,
    )
    events = _lines(
        F.col("timeline"),
        lambda t: F.concat(
            F.lit("- "), times.spaced(t["ts"]), F.lit(" | "), t["event_type"], F.lit(" | "),
            first_chars(t["description"], 200),
        ),
        25,
        fixed.NO_TIMELINE,
    )
    all_actions = F.flatten(F.transform("root_causes", lambda r: F.slice(r["recommended_actions"], 1, 2)))
    actions = _lines(all_actions, lambda a: F.concat(F.lit("- "), a), 6, fixed.NO_ACTIONS)
    signatures = F.array_join(F.transform("top_error_messages", lambda m: first_chars(m, 80)), ", ")
    headline = F.concat(
        F.lit("Automated analysis of **"), F.col("total_lines"), F.lit("** log lines ("), F.col("log_source"),
        F.lit("), **"), F.col("parsed_lines"), F.lit("** structured entries. Error rate **"),
        _percent(F.col("error_rate")), F.lit("**, warnings **"), _percent(F.col("warning_rate")),
        F.lit("**, critical events **"), F.col("critical_count"), F.lit("**. Time range: **"), _time_range(),
        F.lit("**."),
    )
    impact = F.concat(
        F.lit("Top error signatures: "), F.when(signatures == "", "none").otherwise(signatures),
        F.lit(".\nPipeline processing took **"), F.format_string("%.0f ms", _processing_ms(found)),
        F.lit("** (parser version "), F.col("pipeline_version"), F.lit(")."),
    )
    texts = [headline, events, causes, impact, actions, F.lit(fixed.PREVENTION)]
    sections = [F.concat(F.lit(f"## {title}\n"), text) for title, text in zip(fixed.SECTIONS, texts)]
    return F.concat(F.concat_ws("\n\n", *sections), F.lit("\n"))


def _stamp(cfg: Settings) -> Column:
    return F.concat(F.date_format(cfg.now(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def framed(text: Column, cfg: Settings) -> Column:
    """V3: header and footer around a report text."""
    header = F.concat(
        F.lit(f"# {cfg.report_title}\n\n- **generated_at:** "), _stamp(cfg),
        F.lit("\n- **log_source:** "), F.col("log_source"),
        F.lit("\n- **lines_analysed:** "), F.col("total_lines"),
        F.lit(f"\n- **prompt_version:** {cfg.version}\n\n"),
    )
    return F.concat(header, strip(text), F.lit(f"\n\n---\n{cfg.report_title} {cfg.version}"))


def markdown(found: DataFrame, cfg: Settings, write=None) -> DataFrame:
    """V2, V3: ``log_id, report``. ``write`` may turn the prompt column into a report text of its own (V5)."""
    text = body(found) if write is None else F.coalesce(write(prompt_text(cfg)), body(found))
    return found.select("log_id", framed(text, cfg).alias("report"))


def anomaly_json(a: Column) -> Column:
    return F.struct(
        times.iso(a["ts"], "0001-01-01T00:00:00").alias("timestamp"),
        *[a[name].alias(name) for name in ANOMALY[1:]],
    )


def document(found: DataFrame, cfg: Settings, write=None) -> DataFrame:
    """V4: ``log_id`` and the report document as nested columns, ready for ``to_json`` or Parquet."""
    text = body(found) if write is None else F.coalesce(write(prompt_text(cfg)), body(found))
    unknown = "0001-01-01T00:00:00"

    def listed(name: str, to_struct) -> Column:
        return F.transform(F.col(name), to_struct).alias(name)

    return found.select(
        "log_id",
        F.lit(True).alias("ok"),
        F.struct(
            _stamp(cfg).alias("generated_at"),
            "log_source",
            "total_lines",
            F.lit(cfg.version).alias("prompt_version"),
        ).alias("metadata"),
        "severity",
        F.struct(
            "error_rate",
            "warning_rate",
            "critical_count",
            F.array(times.iso(F.col("time_range.start")), times.iso(F.col("time_range.end"))).alias("time_range"),
            _processing_ms(found).alias("processing_time_ms"),
            F.greatest(F.size("anomalies"), F.lit(0)).alias("anomalies_listed"),
            "anomalies_total",
        ).alias("summary"),
        listed(
            "root_causes",
            lambda r: F.struct(
                *[
                    times.iso(r[name]).alias(name) if name == "first_signal_at" else r[name].alias(name)
                    for name in CAUSE
                ]
            ),
        ),
        listed("anomalies", anomaly_json),
        listed(
            "error_clusters",
            lambda c: F.struct(
                *[
                    times.iso(c[name], unknown).alias(name) if name in ("first_seen", "last_seen") else c[name].alias(name)
                    for name in CLUSTER
                ]
            ),
        ),
        listed(
            "timeline",
            lambda t: F.struct(
                times.iso(t["ts"], unknown).alias("timestamp"), *[t[name].alias(name) for name in EVENT[1:]]
            ),
        ),
        framed(text, cfg).alias("incident_report_markdown"),
    )


def json(documents: DataFrame) -> DataFrame:
    """V4 as text: ``log_id, report_json``; lists without rows are written as empty lists."""
    fields = [c for c in documents.columns if c != "log_id"]
    lists = ("root_causes", "anomalies", "error_clusters", "timeline")
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    filled = [
        F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) if c in lists else F.col(c) for c in fields
    ]
    return documents.select("log_id", F.to_json(F.struct(*filled), {"ignoreNullFields": "false"}).alias("report_json"))


def continuations(anomalies: DataFrame, cfg: Settings) -> DataFrame:
    """V4 for logs with more anomalies than fit inline: the rest, in order, as numbered pieces of the same size."""
    packed = _overflow(anomalies, cfg)
    return packed.select("log_id", "part", F.transform("anomalies", anomaly_json).alias("anomalies"))


def prompt_continuations(anomalies: DataFrame, cfg: Settings) -> DataFrame:
    """V5 for the same logs: ``log_id, part, prompt``, each with the next ``report_inline_rows`` anomalies as text."""
    text = F.array_join(F.transform("anomalies", _anomaly_line), "\n")
    opening = F.format_string("KEY ANOMALIES DETECTED (continued, part %d):\n", F.col("part"))
    return _overflow(anomalies, cfg).select("log_id", "part", F.concat(opening, text).alias("prompt"))


def _anomaly_line(a: Column) -> Column:
    return F.concat(
        a["anomaly_type"], F.lit(" ("), a["severity"], F.lit(") z="), F.format_string("%.2f", a["z_score"]),
        F.lit(": "), a["description"],
    )


def _overflow(anomalies: DataFrame, cfg: Settings) -> DataFrame:
    """``log_id, part, anomalies`` of those past the inline ones, placed by severity and hour."""
    if cfg.report_inline_rows is None:
        anomalies, cfg = anomalies.limit(0), cfg.but(report_inline_rows=1)
    rank, _, detector, line = order_keys()
    hour = F.window(F.coalesce("ts", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), "1 hour").getField("start")
    keyed = (
        anomalies.withColumn("rank", rank)
        .withColumn("detector", detector)
        .withColumn("line", line)
        .withColumn("bucket", F.struct("rank", hour.alias("hour")))
    )
    order = [F.col("rank"), F.col("ts").asc_nulls_first(), F.col("detector"), F.col("line")]
    placed = ordered.positions(keyed, ["log_id"], "bucket", order)
    rest = placed.filter(F.col("pos") > cfg.report_inline_rows)
    part = F.floor((F.col("pos") - 1) / cfg.report_inline_rows).alias("part")
    packed = rest.groupBy("log_id", part).agg(
        F.array_sort(F.collect_list(F.struct("pos", *ANOMALY))).alias("anomalies")
    )
    return packed


def prompt_text(cfg: Settings) -> Column:
    """V5: the findings as the text a writer of prose reports would get."""
    causes = _lines(
        F.col("root_causes"),
        lambda r: F.concat(
            F.lit("["), r["category"], F.lit("|"), r["confidence"], F.lit("] "), r["hypothesis"],
            F.lit(" (evidence: "), F.array_join(F.slice(r["evidence"], 1, 5), "; "), F.lit(")"),
        ),
        None,
        "none",
    )
    listed = _lines(F.col("anomalies"), _anomaly_line, None, "none detected")
    left = F.col("anomalies_total") - F.greatest(F.size("anomalies"), F.lit(0))
    anomalies = F.when(left > 0, F.concat(listed, F.format_string("\n(%d more in continuation prompts)", left))).otherwise(listed)

    def services(c: Column) -> Column:
        quoted = F.transform(c["affected_services"], lambda s: F.concat(F.lit("'"), s, F.lit("'")))
        return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))

    clusters = _lines(
        F.col("error_clusters"),
        lambda c: F.concat(
            c["count"].cast("string"), F.lit("x "), first_chars(c["representative_message"], 300),
            F.lit(" services="), services(c),
        ),
        None,
        "none",
    )
    events = _lines(
        F.col("timeline"),
        lambda t: F.concat(
            times.spaced(t["ts"]), F.lit(" "), t["event_type"], F.lit(": "), first_chars(t["description"], 400)
        ),
        None,
        "none",
    )
    sections = "\n".join(f"## {title}" for title in fixed.SECTIONS)
    return F.concat(
        F.lit("Write an incident report based on this analysis:\n\nLOG SOURCE: "), F.col("log_source"),
        F.lit("\nTIME RANGE: "), _time_range(),
        F.lit("\nTOTAL LINES ANALYSED: "), F.col("total_lines"),
        F.lit("\nERROR RATE: "), _percent(F.col("error_rate")),
        F.lit("\n\nROOT CAUSE HYPOTHESES:\n"), causes,
        F.lit("\n\nKEY ANOMALIES DETECTED:\n"), anomalies,
        F.lit("\n\nERROR CLUSTERS (grouped similar errors):\n"), clusters,
        F.lit("\n\nTIMELINE OF SIGNIFICANT EVENTS:\n"), events,
        F.lit(f"\n\nWrite the incident report with these sections:\n{sections}"),
    )


def prompts(found: DataFrame, cfg: Settings) -> DataFrame:
    """V5: ``log_id, system_prompt, prompt``."""
    return found.select("log_id", F.lit(fixed.SYSTEM_PROMPT).alias("system_prompt"), prompt_text(cfg).alias("prompt"))
