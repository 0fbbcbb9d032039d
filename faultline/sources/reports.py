"""Stored results: reports, cluster exports, evaluation cases and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions import times
from faultline.schema import EVAL_CASES, ddl


def with_report_id(documents: DataFrame) -> DataFrame:
    """A random 12-character id per report."""
    return documents.withColumn("report_id", F.substring(F.uuid(), 1, 12))


def save(documents: DataFrame, path: str) -> None:
    """Appends report documents as JSON lines, many reports per file."""
    with_report_id(documents).write.mode("append").option("ignoreNullFields", "false").json(path)


def latest(spark: SparkSession, path: str, cfg: Settings) -> DataFrame:
    """The newest reports in five fields; unreadable documents are left out."""
    schema = (
        "report_id string, severity string, "
        "metadata struct<log_source: string, total_lines: bigint, generated_at: string>, _broken string"
    )
    stored = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    newest = (
        stored.select("*", F.col("_metadata.file_modification_time").alias("stored_at"))
        .orderBy(F.col("stored_at").desc(), F.col("metadata.generated_at").desc(), "report_id")
    )
    if cfg.listing_rows is not None:
        newest = newest.limit(cfg.listing_rows)
    return newest.filter(F.col("_broken").isNull()).select(
        F.col("report_id").alias("id"),
        "severity",
        "metadata.log_source",
        "metadata.total_lines",
        "metadata.generated_at",
    )


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """The seven export columns."""
    return clusters.select(
        "log_id",
        F.col("cluster_id").alias("Cluster ID"),
        F.coalesce("severity", F.lit("")).alias("Severity"),
        F.col("count").alias("Count"),
        F.coalesce("representative_message", F.lit("")).alias("Message"),
        times.iso(F.col("first_seen"), "").alias("First Seen"),
        times.iso(F.col("last_seen"), "").alias("Last Seen"),
        F.array_join("affected_services", "; ").alias("Services"),
    )


def export_clusters(clusters: DataFrame, path: str) -> None:
    """CSV with doubled quotes, one folder per log."""
    cluster_rows(clusters).write.mode("overwrite").partitionBy("log_id").option("escape", '"').csv(path, header=True)


def eval_cases(spark: SparkSession, path: str, cfg: Settings) -> DataFrame:
    """The first cases of a JSON array file, in file order."""
    cases = spark.read.schema(ddl(EVAL_CASES)).json(path, multiLine=True)
    if cfg.eval_rows is None:
        return cases
    return cases.withColumn("_n", F.monotonically_increasing_id()).orderBy("_n").limit(cfg.eval_rows).drop("_n")


def save_evaluation(summary: DataFrame, rows: DataFrame, path: str, cfg: Settings) -> None:
    """The figures and the rows of one run, stamped with its time."""
    stamp = F.date_format(cfg.now(), "yyyyMMdd_HHmmss").alias("run")
    summary.select(stamp, "*").write.mode("append").json(f"{path}/summary")
    rows.select(stamp, "*").write.mode("append").json(f"{path}/rows")
