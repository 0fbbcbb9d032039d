"""The whole analysis of many logs (V8): lines in, one written table per result out."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.operators import anomalies, clusters, detect, report, root_causes, summary, timeline
from faultline.operators.clusters import Embedder
from faultline.operators.parse import dispatch
from faultline.plans.staging import Staging


class Results(NamedTuple):
    entries: DataFrame
    summary: DataFrame
    anomalies: DataFrame
    error_clusters: DataFrame
    timeline: DataFrame
    root_causes: DataFrame


def count_fleet(logs: DataFrame, cfg: Settings) -> Settings:
    """Settings with the number of logs, which decides whether one-row-per-log frames may be broadcast."""
    return cfg.but(fleet=logs.select("log_id").distinct().count())


def analyse_entries(
    entries: DataFrame,
    cfg: Settings,
    lines: DataFrame | None = None,
    formats: DataFrame | None = None,
    skipped: DataFrame | None = None,
    logs: DataFrame | None = None,
    embed: Embedder | None = None,
    staging: Staging | None = None,
    written: bool = False,
) -> Results:
    """All result tables from entries. With ``staging`` each table is written once and what follows reads it back.

    The entries themselves, which a dozen steps read, are written too unless they are ``written`` already.
    """

    def kept(name: str, frame: DataFrame) -> DataFrame:
        return frame if staging is None else staging.table(name, frame)

    given = entries
    if not written:
        # nothing of the analysis looks at raw lines or metadata
        entries = kept("entries", entries if staging is None else entries.drop("raw_line", "metadata"))
    found = kept("anomalies", anomalies.all_anomalies(entries, cfg, staging and staging.table))
    causes = kept("root_causes", root_causes.analyse(entries, logs))
    totals = summary.log_summary(entries, cfg, lines, formats, skipped, logs)
    return Results(
        entries=given,
        summary=kept("summary", summary.grade(totals, found, causes)),
        anomalies=found,
        error_clusters=kept("error_clusters", clusters.error_clusters(entries, cfg, embed, staging and staging.table)),
        timeline=kept("timeline", timeline.build(entries, found, cfg, staging and staging.table)),
        root_causes=causes,
    )


def detect_once(
    lines: DataFrame, cfg: Settings, staging: Staging, formats: DataFrame | None = None, logs: DataFrame | None = None
) -> tuple[DataFrame, set[str]]:
    """Formats per log as a staged table, and the names of those that occur."""
    formats = staging.table("formats", detect.formats(lines, cfg, logs) if formats is None else formats)
    # one row per distinct format name
    return formats, {row.format for row in formats.select("format").distinct().collect()}


def parse_once(
    lines: DataFrame,
    cfg: Settings,
    staging: Staging,
    formats: DataFrame | None = None,
    custom: dict[str, str] | None = None,
    logs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Formats and parsed lines as staged tables. Only parsers of formats that occur become part of the plan."""
    formats, present = detect_once(lines, cfg, staging, formats, logs)
    return formats, staging.table("parsed", dispatch.parse(lines, cfg, formats, custom, present, staging.table))


def analyse(
    lines: DataFrame,
    cfg: Settings,
    formats: DataFrame | None = None,
    custom: dict[str, str] | None = None,
    logs: DataFrame | None = None,
    embed: Embedder | None = None,
    staging: Staging | None = None,
) -> Results:
    """V8: raw lines of any number of logs to all result tables.

    Lines are parsed once and kept, like every result table, in the folder that ``spark.checkpoint.dir`` names. The
    summary says how long the run took for all its logs (``processing_time_ms``).
    """
    began = time.perf_counter()
    staging = staging or Staging(lines.sparkSession)
    formats, parsed = parse_once(lines, cfg, staging, formats, custom, logs)
    if "log_source" not in formats.columns:
        known = F.col("format").isin([f.name for f in detect.SNIFFED])
        formats = formats.withColumn("log_source", F.when(known, F.col("format")).otherwise("unknown"))
    entries, skipped = dispatch.entries(parsed), dispatch.skipped(parsed)
    results = analyse_entries(entries, cfg, lines, formats, skipped, logs, embed, staging, written=True)
    elapsed = F.lit((time.perf_counter() - began) * 1000)
    return results._replace(summary=results.summary.withColumn("processing_time_ms", elapsed))


def findings(results: Results, cfg: Settings) -> DataFrame:
    """The input of every report form: one row per log."""
    return report.findings(
        results.summary, results.anomalies, results.error_clusters, results.timeline, results.root_causes, cfg
    )
