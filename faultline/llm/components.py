"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node it can reach) of every node in ``links`` (a, b of type long; null links dropped).

    Large star: every node hands its larger neighbours to the smallest node around it; small star: it hands itself and
    its smaller neighbours to the smallest. Both keep the components and number of links at most; repeated until nothing
    changes the links form one star per component, in a number of rounds that grows with the logarithm of the longest
    chain. Each half is a partial aggregate and a join of written tables, whose hot nodes Spark's adaptive join splits.
    """
    pair = [F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")]
    edges = scratch.table("star", links.where("a <> b").select(*pair).distinct())
    seen, rounds, last = None, 0, "star"

    def digest(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    def star(name: str, around: DataFrame) -> DataFrame:
        least = scratch.table(f"{name}_least", around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        return around.join(least, "u")

    now = digest(edges)
    while now[0] and now != seen:
        seen, rounds = now, rounds + 1
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = star(f"large{rounds}", both).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        wide = scratch.table(f"large{rounds}", large.distinct())
        down = star(f"small{rounds}", wide.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        small = down.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(down.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        edges = scratch.table(f"star{rounds}", small.where("hi <> lo").distinct())
        scratch.drop(last, f"large{rounds}", f"large{rounds}_least", f"small{rounds}_least")
        last, now = f"star{rounds}", digest(edges)
    ends = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return ends.unionByName(edges.select("lo", "lo").toDF("node", "root").distinct())
