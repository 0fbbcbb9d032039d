"""Connected components and density clusters from a table of pairs, by joins and partial aggregates (C6 at any size)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import ordered

Stage = Callable[[str, DataFrame], DataFrame]


def roots(pairs: DataFrame, stage: Stage) -> DataFrame:
    """``log_id, node, root`` of every node in ``pairs`` (log_id, a, b): root is the smallest node it can reach.

    Each round joins every node's smaller neighbours to the smallest of its neighbours and itself, first over the larger
    and then over the smaller side, so that chains halve; rounds end when no pair changes. Frames are written by ``stage``,
    the joins are on (log, node), and a hot node's rows can be split as its smallest neighbour is a written row.
    """

    def lowest(name: str, directed: DataFrame) -> DataFrame:
        least = directed.groupBy("log_id", "u").agg(F.min("v").alias("v")).select("log_id", "u", F.least("u", "v").alias("m"))
        return directed.join(stage(name, least), ["log_id", "u"])

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("log_id", "hi", "lo").cast("decimal(38,0)"))).first())

    between = pairs.filter("a <> b").select("log_id", F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links, seen, rounds = stage("links0", between.distinct()), None, 0
    now = state(links)
    while now[0] and now != seen:
        seen, rounds = now, rounds + 1
        up = links.select("log_id", F.col("hi").alias("u"), F.col("lo").alias("v"))
        both = up.unionByName(links.select("log_id", F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = lowest(f"larger{rounds}", both).filter("v > u").select("log_id", F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stage(f"moved{rounds}", large.distinct())
        down = lowest(f"smaller{rounds}", large.select("log_id", F.col("hi").alias("u"), F.col("lo").alias("v")))
        small = down.select("log_id", F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(
            down.select("log_id", F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
        links = stage(f"links{rounds}", small.filter("hi <> lo").distinct())
        now = state(links)
    ends = links.select("log_id", F.col("hi").alias("node"), F.col("lo").alias("root"))
    return ends.unionByName(links.select("log_id", F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def density_labels(points: DataFrame, pairs: DataFrame, min_samples: int, stage: Stage, chunk: int = 50_000) -> DataFrame:
    """``log_id, ordinal, label`` of every point: clusters by neighbour counts, numbered by their lowest core member.

    ``points`` has log_id, ordinal and ``counts_itself`` (whether a point is its own neighbour); ``pairs`` its neighbours
    (log_id, a, b), each pair once. A point with ``min_samples`` neighbours is a core point; core points that are
    neighbours form a cluster; any other neighbour of a core point goes to the lowest-numbered cluster next to it, and
    what is left is noise, -1.
    """
    ends = pairs.select("log_id", F.col("a").alias("ordinal"), F.col("b").alias("other"))
    ends = ends.unionByName(pairs.select("log_id", F.col("b").alias("ordinal"), F.col("a").alias("other")))
    degrees = ends.groupBy("log_id", "ordinal").agg(F.count(F.lit(1)).alias("near"))
    core = stage("core_points", core_points(points, degrees, min_samples))
    other = core.select("log_id", F.col("ordinal").alias("other"))
    to_core = stage("core_pairs", ends.join(other, ["log_id", "other"]).select("log_id", "ordinal", "other"))
    inner = to_core.join(core, ["log_id", "ordinal"], "left_semi")
    inner = inner.filter("ordinal < other").select("log_id", F.col("ordinal").alias("a"), F.col("other").alias("b"))
    return linked_labels(points, core, inner, to_core.join(core, ["log_id", "ordinal"], "left_anti"), stage, chunk)


def core_points(points: DataFrame, degrees: DataFrame, min_samples: int) -> DataFrame:
    """``log_id, ordinal`` of the points with ``min_samples`` neighbours; ``degrees`` has log_id, ordinal and near."""
    near = F.coalesce("near", F.lit(0)) + F.col("counts_itself").cast("int")
    return points.join(degrees, ["log_id", "ordinal"], "left").filter(near >= min_samples).select("log_id", "ordinal")


def linked_labels(points: DataFrame, core: DataFrame, links: DataFrame, borders: DataFrame, stage: Stage, chunk: int = 50_000) -> DataFrame:
    """``density_labels`` from ``core`` points, ``links`` (log_id, a, b) that join those of a cluster, and ``borders``
    (log_id, ordinal, other): the other points that are neighbours of core points."""
    found = roots(links, stage)
    rooted = core.join(found.withColumnRenamed("node", "ordinal"), ["log_id", "ordinal"], "left")
    rooted = rooted.select("log_id", "ordinal", F.coalesce("root", "ordinal").alias("root"))
    firsts = stage("cluster_roots", rooted.select("log_id", "root").distinct().withColumn("_chunk", F.floor(F.col("root") / chunk)))
    numbered = ordered.positions(firsts, ["log_id"], "_chunk", ["root"], "label").select("log_id", "root", (F.col("label") - 1).alias("label"))
    inside = stage("core_labels", rooted.join(numbered, ["log_id", "root"]).select("log_id", "ordinal", "label"))
    reached = borders.join(inside.withColumnRenamed("ordinal", "other"), ["log_id", "other"])
    border = reached.groupBy("log_id", "ordinal").agg(F.min("label").alias("label"))
    labels = inside.unionByName(border)
    return points.select("log_id", "ordinal").join(labels, ["log_id", "ordinal"], "left").select(
        "log_id", "ordinal", F.coalesce("label", F.lit(-1).cast("bigint")).alias("label")
    )
