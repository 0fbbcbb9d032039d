"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import language_id, line_dedup, mixing, simhash_dedup
from faultline.llm.queries import MIN_SITES, MOST, SHARE, WEIGHTS, packed
from faultline.llm.shared import Scratch, table

#: SQL has neither the trained models nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language; texts without letters go."""
    model = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    kept = language_id.predict(docs, model).where("lang_pred <> 'und'")
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeats of lines that many sources share."""
    return line_dedup.remove(docs, F.col("source"), MIN_SITES, Scratch(spark)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.dedup(docs, Scratch(spark)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs, WEIGHTS, SHARE, MOST, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packed(spark, docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return docs
