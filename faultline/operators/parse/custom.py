"""User-defined line patterns with named groups.

Patterns are written in Python's syntax, checked on the driver, and rewritten to plain groups for the JVM matcher.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.config import Settings
from faultline.functions import times
from faultline.functions.text import null_if_empty, pattern, strip
from faultline.operators.joins import attach
from faultline.operators.parse.forms import LineForm, LogFormat, always, level_of
from faultline.schema import ENTRY_FIELDS

KNOWN_GROUPS = ("message", "timestamp", "level", "service", "host")


def validated(name: str, expression: str, description: str = "") -> dict:
    """The expression must compile and have a ``message`` group."""
    try:
        compiled = re.compile(expression)
    except re.error as problem:
        raise ValueError(f"format {name!r}: the pattern does not compile: {problem}") from problem
    if "message" not in compiled.groupindex:
        raise ValueError(f"format {name!r}: the pattern needs a group (?P<message>...)")
    return {
        "name": name,
        "pattern": expression,
        "description": description,
        "groups": sorted(compiled.groupindex),
    }


def jvm_pattern(expression: str) -> tuple[str, dict[str, int]]:
    """The expression with plain groups, and the position of every named group."""
    positions = dict(re.compile(expression).groupindex)
    plain = re.sub(r"\(\?P<[^>]+>", "(", expression)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\{positions[m.group(1)]}", plain)
    return pattern(plain), positions


def custom_time(text):
    """The first layout that fits; a layout without a year gives 1900."""
    s = strip(text)
    return F.coalesce(
        times.year_month_day(s),
        times.slashed(s),
        times.day_month_year_unzoned(s),
        times.month_day(s, F.lit("1900")),
    )


def custom_format(name: str, expression: str) -> LogFormat:
    """A format whose unmatched lines are kept at level UNKNOWN and counted as skipped."""
    validated(name, expression)
    jvm, positions = jvm_pattern(expression)

    def matched(group, text, cfg):
        def named(part):
            return F.regexp_extract(text, jvm, positions[part])

        cols = {"message": named("message"), "level": F.lit("UNKNOWN")}
        if "timestamp" in positions:
            cols["ts"] = custom_time(named("timestamp"))
        if "level" in positions:
            cols["level"] = level_of(strip(named("level")), fixed.CUSTOM_LEVELS, "UNKNOWN")
        for part in ("service", "host"):
            if part in positions:
                cols[part] = null_if_empty(named(part))
        return cols

    def unmatched(group, text, cfg):
        return {"level": F.lit("UNKNOWN"), "message": strip(text)}

    return LogFormat(
        name,
        "unknown",
        (
            LineForm(f"{name}:matched", "unknown", matched, applies=lambda text: text.rlike(jvm)),
            LineForm(f"{name}:unmatched", "unknown", unmatched, applies=always, counts_as_skipped=True),
        ),
        text=lambda raw: raw,
    )


def confidence(lines, expression: str):
    """Share of the given lines that match, per log."""
    jvm, _ = jvm_pattern(expression)
    return lines.groupBy("log_id").agg(F.avg(F.col("raw_line").rlike(jvm).cast("double")).alias("confidence"))


def format_table(spark: SparkSession, formats: dict[str, str]) -> DataFrame:
    """Checked patterns as a table: name, pattern for the JVM matcher, and the position of every known group (0: none)."""
    rows = []
    for name, expression in formats.items():
        validated(name, expression)
        jvm, positions = jvm_pattern(expression)
        rows.append((name, jvm, *[positions.get(part, 0) for part in KNOWN_GROUPS]))
    return spark.createDataFrame(rows, "name string, pattern string, " + ", ".join(f"{part} int" for part in KNOWN_GROUPS))


def parse_many(lines: DataFrame, assigned: DataFrame, formats: DataFrame, cfg: Settings) -> DataFrame:
    """P31-P34 for many patterns at once: every non-blank line by the pattern of its log.

    ``assigned`` has log_id and name, at most one row per log; ``formats`` comes from ``format_table``. Patterns are columns,
    so their number does not widen the plan; the matcher keeps the last one, and lines of a log come together. Lines of
    logs without a pattern are left out, as are those whose name ``formats`` lacks. Unmatched lines are kept at level
    UNKNOWN and counted as skipped.
    """
    # a handful of rows per registered format, made on the driver
    per_log = assigned.join(F.broadcast(formats), "name").drop("name")
    found = attach(lines.select("log_id", "line_number", "raw_line"), per_log, cfg)
    found = found.filter(strip(F.col("raw_line")) != "").withColumn("_hit", F.expr("regexp_instr(raw_line, pattern) > 0"))

    def named(part: str):
        return F.when(F.col(part) > 0, F.expr(f"regexp_extract(raw_line, pattern, {part})"))

    values = {
        "ts": F.when(F.col("_hit"), custom_time(named("timestamp"))),
        "level": F.when(F.col("_hit"), level_of(strip(named("level")), fixed.CUSTOM_LEVELS, "UNKNOWN")).otherwise("UNKNOWN"),
        "source": F.lit("unknown"),
        "message": F.when(F.col("_hit"), named("message")).otherwise(strip(F.col("raw_line"))),
        "service": F.when(F.col("_hit"), null_if_empty(named("service"))),
        "host": F.when(F.col("_hit"), null_if_empty(named("host"))),
        "metadata": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    }
    columns = [values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in ENTRY_FIELDS.items()]
    return found.select("log_id", "line_number", "raw_line", *columns, F.lit(True).alias("is_entry"), (~F.col("_hit")).alias("is_skipped"))
