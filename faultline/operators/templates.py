"""Message templates: normalisation, exact deduplication and the choice of templates worth comparing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fixed
from faultline.config import Settings
from faultline.functions.text import bind, contains_any, first_chars, pattern, strip
from faultline.operators import ordered
from faultline.operators.anomalies import is_error


# per template rule, a cheap test that it can apply at all; the last two rules are their own test
POSSIBLE = (
    lambda text: text.contains("-"),
    lambda text: text.contains("."),
    lambda text: text.contains("/") | text.contains("\\"),
    lambda text: F.length(text) >= 32,
    None,
    None,
)


def _rule(body: str, mark: str, possible) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        replaced = F.regexp_replace(text, pattern(body), mark)
        return replaced if possible is None else F.when(possible(text), replaced).otherwise(text)

    return apply


def normalise(message: Column) -> Column:
    """Volatile parts of a message replaced by placeholders."""
    text = F.lower(message)
    for (body, mark), possible in zip(fixed.TEMPLATE_RULES, POSSIBLE):
        text = bind(text, _rule(body, mark, possible))
    return strip(text)


def keyed_errors(entries: DataFrame) -> DataFrame:
    """F1 with the template of every error."""
    text = first_chars(F.coalesce("message", F.lit("")), 2000)
    return entries.filter(is_error()).select(
        "log_id",
        "line_number",
        "ts",
        "level",
        "service",
        text.alias("message"),
        normalise(text).alias("template"),
    )


def dedup(
    keyed: DataFrame, cfg: Settings, stage: Callable[[str, DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per log and template, with its first message; ``ordinal`` counts first appearances from 0.

    Numbering reads the grouped templates twice; ``stage`` writes them once in between, so that messages are
    normalised only once.
    """
    grouped = keyed.groupBy("log_id", "template").agg(
        F.min(F.struct("line_number", "message")).alias("first"),
        F.count(F.lit(1)).alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.bool_or(F.col("level") == "CRITICAL").alias("critical"),
    )
    flat = grouped.select(
        "log_id",
        "template",
        F.col("first.line_number").alias("first_line"),
        F.col("first.message").alias("message"),
        "count",
        "first_seen",
        "last_seen",
        "critical",
    ).withColumn("chunk", F.floor(F.col("first_line") / cfg.chunk_lines))
    if stage is not None:
        flat = stage("template_counts", flat)
    numbered = ordered.positions(flat, ["log_id"], "chunk", ["first_line"], "ordinal")
    return numbered.withColumn("ordinal", F.col("ordinal") - 1).drop("chunk")


def tier(message: Column) -> Column:
    """C3."""
    return (
        F.when(contains_any(F.upper(message), fixed.TOP_TIER_MARKS), 0)
        .when(contains_any(F.lower(message), fixed.SIGNAL_WORDS), 1)
        .otherwise(2)
    )


def prioritise(templates: DataFrame, cfg: Settings) -> DataFrame:
    """C4: the templates of each log that get compared, at most ``encode_cap`` of them (None: all)."""
    tiered = templates.withColumn("tier", tier(F.col("message")))
    return ordered.top(
        tiered, ["log_id"], [F.col("tier"), F.col("count").desc(), F.col("ordinal")], cfg.encode_cap
    )


def left_out(templates: DataFrame, kept: DataFrame) -> DataFrame:
    """Templates that did not make it into ``kept``."""
    return templates.join(kept.select("log_id", "ordinal"), ["log_id", "ordinal"], "left_anti")
