"""Exact deduplication by a tree-merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import SPACE, Scratch, text_of

#: Runs at the leaves, and how many runs meet in one merge; 4,096 leaves at 16 a merge make three rounds.
RUNS = 4_096
FAN = 16
KEY = ["digest", "bytes", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Each row goes to a leaf run by the hash of its row number and becomes a digest; a leaf keeps one row per digest with the
    smallest doc_id and a count. In each round sixteen runs meet, are sorted by digest and merged, keeping again the
    smallest doc_id, until one run is left. The answers then go back down the same tree, so that no step ever joins
    more than sixteen rows of a merge or one leaf's share of a digest: a text that a third of all rows repeat is spread
    over all leaves. Texts count as equal when SHA-256, length and a second hash of the normalised text agree.

    A null text counts as empty. Null doc_ids come after all others; keep_id is null where a group has no other. Among
    rows with the same text and doc_id only one is kept. Other columns are ignored. An empty table gives no rows.
    """
    text = normalised(text_of())
    rows = scratch.table(
        "digests",
        docs.select("doc_id", text.alias("body")).select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.unhex(F.sha2("body", 256)).alias("digest"),
            F.octet_length("body").alias("bytes"),
            F.xxhash64("body").alias("check"),
        ),
    ).withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(RUNS)).cast("int"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")
    levels = [
        scratch.table("run0", rows.groupBy("run", *KEY).agg(F.min(first).alias("first"), F.count("*").alias("n")))
    ]
    runs = RUNS
    while runs > 1:
        runs = -(-runs // FAN)
        merged = levels[-1].groupBy(F.expr(f"int(run div {FAN})").alias("run"), *KEY)
        levels.append(scratch.table(f"run{len(levels)}", merged.agg(F.min("first").alias("first"), F.sum("n").alias("n"))))
    answer = levels.pop().select("run", *KEY, "first", "n")
    while levels:
        below = levels.pop().select(F.col("run").alias("leaf"), F.expr(f"int(run div {FAN})").alias("run"), *KEY)
        answer = below.join(answer, ["run", *KEY]).drop("run").withColumnRenamed("leaf", "run")
    return rows.join(answer, ["run", *KEY]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
