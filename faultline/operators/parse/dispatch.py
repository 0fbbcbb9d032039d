"""Parsing many logs of many formats in one plan (J3, D7, D8, and all of P1-P34)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions.text import bind, strip
from faultline.operators import detect
from faultline.operators.joins import attach
from faultline.operators.parse import tracebacks
from faultline.operators.parse.custom import custom_format
from faultline.operators.parse.forms import HEADER, SKIPPED, LogFormat, columns_of
from faultline.schema import ENTRY_FIELDS, LOG_ENTRIES, LOG_LINES

Stage = Callable[[str, DataFrame], DataFrame]

ENTRY_COLUMNS = list(LOG_ENTRIES)


def _per_format(formats: list[LogFormat], expression) -> Column:
    if len(formats) == 1:
        return expression(formats[0])
    chain = reduce(
        lambda chain, f: chain.when(F.col("format") == f.name, expression(f)),
        formats[1:-1],
        F.when(F.col("format") == formats[0].name, expression(formats[0])),
    )
    return chain.otherwise(expression(formats[-1]))


def parse_lines(lines: DataFrame, formats: list[LogFormat], cfg: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every non-blank line with its form and entry columns; skipped lines have NULL entry columns. ``keep`` names columns
    that pass through."""
    forms = [form for f in formats for form in f.forms]
    with_form = (
        lines.filter(strip(F.col("raw_line")) != "")
        .withColumn("_text", _per_format(formats, lambda f: f.text(F.col("raw_line"))))
        .withColumn("_form", bind(F.col("_text"), lambda text: _per_format(formats, lambda f: f.choose(text))))
    )
    capturing = [form for form in forms if form.grammar is not None]
    captured = F.lit(None).cast("array<string>")
    if capturing:
        captured = reduce(
            lambda chain, form: chain.when(F.col("_form") == form.name, form.captured(F.col("_text"))),
            capturing[1:],
            F.when(F.col("_form") == capturing[0].name, capturing[0].captured(F.col("_text"))),
        )
    columns = columns_of(
        forms, F.col("_form"), lambda i: F.get("_groups", F.lit(i - 1)), F.col("_text"), cfg
    )
    skipped = [SKIPPED] + [form.name for form in forms if form.counts_as_skipped]
    return with_form.withColumn("_groups", captured).select(
        "log_id",
        "line_number",
        "raw_line",
        *[columns[name].alias(name) for name in ENTRY_FIELDS],
        (~F.col("_form").isin(SKIPPED, HEADER)).alias("is_entry"),
        F.col("_form").isin(*skipped).alias("is_skipped"),
        *keep,
    )


def _parsed_python(lines: DataFrame, cfg: Settings, stage: Stage | None = None) -> DataFrame:
    assigned = tracebacks.assign(lines, cfg, stage)
    single = parse_lines(tracebacks.singles(assigned), [detect.KNOWN["python"]], cfg)
    made = {"level": F.lit("ERROR"), "source": F.lit("python")}
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    values = {name: F.lit(None) for name in ENTRY_FIELDS} | {"metadata": empty} | made
    values |= {"message": F.col("message"), "stack_trace": F.col("stack_trace")}
    merged = tracebacks.merged(assigned).select(
        "log_id",
        "line_number",
        "raw_line",
        *[values[name].cast(kind).alias(name) for name, kind in ENTRY_FIELDS.items()],
        F.lit(True).alias("is_entry"),
        F.lit(False).alias("is_skipped"),
    )
    return single.unionByName(merged)


def parse_as(
    lines: DataFrame, log_format: str | LogFormat, cfg: Settings, stage: Stage | None = None
) -> DataFrame:
    """All lines parsed as one declared format, with ``is_entry`` and ``is_skipped``."""
    known = detect.KNOWN[log_format] if isinstance(log_format, str) else log_format
    if known.name == "python":
        return _parsed_python(lines.select(*LOG_LINES), cfg, stage)
    return parse_lines(lines.select(*LOG_LINES), [known], cfg)


def parse(
    lines: DataFrame,
    cfg: Settings,
    formats: DataFrame | None = None,
    custom: dict[str, str] | None = None,
    present: set[str] | None = None,
    stage: Stage | None = None,
) -> DataFrame:
    """Lines of all logs parsed by the format of their log, with ``is_entry`` and ``is_skipped``.

    ``formats`` (``log_id, format``) defaults to detection; it may name formats of ``custom`` (name -> pattern).
    ``present`` names the formats that occur, when known; parsers of other formats then stay out of the plan.
    """
    if formats is None:
        formats = detect.formats(lines, cfg)
    typed = attach(lines.select(*LOG_LINES), formats.select("log_id", "format"), cfg)
    known = detect.KNOWN | {name: custom_format(name, expression) for name, expression in (custom or {}).items()}
    wanted = [f for name, f in known.items() if present is None or name in present]
    straight = [f for f in wanted if f.name != "python"]
    is_python = F.col("format") == "python"
    parts = []
    if straight:
        parts.append(parse_lines(typed.filter(~is_python), straight, cfg))
    if len(straight) < len(wanted) or not straight:
        parts.append(_parsed_python(typed.filter(is_python).drop("format"), cfg, stage))
    return reduce(DataFrame.unionByName, parts)


def entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_entry").select(*ENTRY_COLUMNS)


def skipped(parsed: DataFrame) -> DataFrame:
    """Lines per log that no form matched; logs with none have no row."""
    return parsed.filter("is_skipped").groupBy("log_id").agg(F.count(F.lit(1)).alias("skipped_lines"))
