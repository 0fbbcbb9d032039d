"""Quality figures of analyses against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(graded: DataFrame, anomalies: DataFrame, clusters: DataFrame, root_causes: DataFrame) -> DataFrame:
    """What the analysis found per log, as one row each; the type and category sets are closed and small."""
    kinds = anomalies.groupBy("log_id").agg(
        F.array_sort(F.collect_set("anomaly_type")).alias("anomaly_types"), F.count(F.lit(1)).alias("anomaly_count")
    )
    categories = root_causes.groupBy("log_id").agg(F.array_sort(F.collect_set("category")).alias("root_categories"))
    sizes = clusters.groupBy("log_id").agg(F.count(F.lit(1)).alias("cluster_count"))
    elapsed = "processing_time_ms" if "processing_time_ms" in graded.columns else None
    joined = graded.join(kinds, "log_id", "left").join(categories, "log_id", "left").join(sizes, "log_id", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("log_id").alias("id"),
        (F.col(elapsed) if elapsed else F.lit(0.0)).alias("elapsed_ms"),
        "log_source",
        "severity",
        F.coalesce("anomaly_types", none).alias("anomaly_types"),
        F.coalesce("root_categories", none).alias("root_categories"),
        F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
    )


def rows(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Expected against found, one row per case; a case without an outcome found nothing and counts as missed."""
    expected = F.array_distinct(F.coalesce("expected_anomaly_types", F.array().cast("array<string>")))
    clean = F.coalesce("expect_no_anomalies", F.lit(False))
    none = F.array().cast("array<string>")
    types, categories = F.coalesce("anomaly_types", none), F.coalesce("root_categories", none)
    missed = F.col("cluster_count").isNull()
    return cases.join(found, "id", "left").select(
        "id",
        "elapsed_ms",
        "log_source",
        "severity",
        types.alias("anomaly_types"),
        categories.alias("root_categories"),
        F.when(missed, False).otherwise(F.col("log_source") == F.col("expected_log_source")).alias("source_ok"),
        F.size(expected).alias("types_expected"),
        F.size(F.array_intersect(expected, types)).alias("types_found"),
        F.array_contains(categories, F.col("expected_root_cause_category")).alias("cause_ok"),
        F.when(missed, False).otherwise(F.col("severity") == F.col("expected_severity")).alias("severity_ok"),
        F.when(missed, False)
        .otherwise(F.col("cluster_count") >= F.coalesce("expected_min_clusters", F.lit(0)))
        .alias("clusters_ok"),
        F.coalesce(clean & (F.col("anomaly_count") > 0), F.lit(False)).alias("false_positive"),
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """One row; shares of an empty set are 0."""

    def share(name: str):
        return F.coalesce(F.avg(F.coalesce(F.col(name), F.lit(False)).cast("double")), F.lit(0.0))

    expected = F.coalesce(F.sum("types_expected"), F.lit(0))
    return evaluated.agg(
        F.count(F.lit(1)).alias("cases"),
        share("source_ok").alias("log_source_accuracy"),
        (F.coalesce(F.sum("types_found"), F.lit(0)) / F.greatest(expected, F.lit(1))).alias("anomaly_type_recall"),
        share("cause_ok").alias("root_cause_category_accuracy"),
        share("severity_ok").alias("severity_accuracy"),
        share("clusters_ok").alias("cluster_detection_rate"),
        share("false_positive").alias("false_positive_rate"),
        F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("avg_processing_time_ms"),
    )
