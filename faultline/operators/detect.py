"""Format detection from the first lines of every log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions.text import strip
from faultline.operators.parse import docker, generic, k8s, nginx, python, systemd

# in tie-break order
SNIFFED = (nginx.FORMAT, python.FORMAT, docker.FORMAT, k8s.FORMAT, systemd.FORMAT)
KNOWN = {f.name: f for f in (*SNIFFED, generic.FORMAT)}


def scores(lines: DataFrame, cfg: Settings) -> DataFrame:
    """One row per log, one score column per format. Blank lines count in the denominator.

    The same pass counts all lines of a log (``total_lines``), so that the text is not read again for that.
    """
    # lines past the sample have no text, so no test runs on them
    text = strip(F.col("raw_line"))
    if cfg.sample_lines is not None:
        text = F.when(F.col("line_number") <= cfg.sample_lines, text)
    names = [name for f in SNIFFED for name in f.hits]
    counted = lines.select("log_id", text.alias("line")).select(
        "log_id",
        F.col("line").isNotNull().alias("_sampled"),
        *[
            F.when(F.col("line").isNotNull(), f.hits[name](F.col("line")).cast("int")).alias(f"_{name}")
            for f in SNIFFED
            for name in f.hits
        ],
    )
    sums = counted.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if("_sampled").alias("sample_size"),
        *[F.sum(f"_{name}").alias(f"_{name}") for name in names],
    )
    hit = {name: F.coalesce(F.col(f"_{name}"), F.lit(0)).cast("double") for name in names}
    size = F.greatest(F.col("sample_size"), F.lit(1)).cast("double")
    return sums.select("log_id", "total_lines", "sample_size", *[f.score(hit, size).alias(f.name) for f in SNIFFED])


def formats(lines: DataFrame, cfg: Settings, logs: DataFrame | None = None) -> DataFrame:
    """``log_id, format, log_source, score, total_lines``. ``logs`` adds logs that have no line at all."""
    scored = scores(lines, cfg)
    if logs is not None:
        scored = logs.select("log_id").join(scored, "log_id", "left")
    names = [f.name for f in SNIFFED]
    best = F.coalesce(F.greatest(*names), F.lit(0.0))
    winner = reduce(
        lambda chain, name: chain.when(F.col(name) == F.col("score"), name),
        names,
        F.when(F.col("score") <= cfg.accept_score, "generic"),
    )
    chosen = scored.withColumn("score", best).withColumn("format", winner)
    source = F.when(F.col("format") == "generic", "unknown").otherwise(F.col("format"))
    total = F.coalesce("total_lines", F.lit(0)).alias("total_lines")
    return chosen.select("log_id", "format", source.alias("log_source"), "score", total)
