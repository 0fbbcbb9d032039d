"""Intermediate tables in the shared folder the cluster names, for lineage that must survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one of this machine only where the session itself is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="faultline-")


class Staging:
    """Writes frames to a fresh folder below ``spark.checkpoint.dir`` and reads them back."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"

    def table(self, name: str, frame: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        writer = frame.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)
