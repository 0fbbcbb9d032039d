"""Similarity clusters over the templates of each log.

Logs of up to ``IN_TASK_ROWS`` vectors are labelled by one task each, from one similarity matrix of bounded size. Larger
ones are compared block by block, and joins over neighbour counts and links follow. Both give the same labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import Settings
from faultline.functions import density
from faultline.functions.text import first_chars
from faultline.functions.vectors import dot, hashed_embedder, norm
from faultline.operators import components, ordered, similarity, templates
from faultline.operators.anomalies import is_error

# the task code travels with the job, so executors need NumPy and PyArrow but not this package
cloudpickle.register_pickle_by_value(density)

Embedder = Callable[[DataFrame], DataFrame]


#: Vectors of a log that one task may compare with each other.
IN_TASK_ROWS = 2_000

Stage = Callable[[str, DataFrame], DataFrame]


def edges(vectors: DataFrame, cfg: Settings, stage: Stage, block_rows: int = similarity.BLOCK_ROWS) -> DataFrame:
    """Pairs of one log within cosine distance ``eps``, as ``log_id, a, b, distance`` with a < b; logs of any size."""
    return similarity.all_pairs(vectors, cfg.eps, stage, block_rows)


def _label_in_tasks(vectors: DataFrame, cfg: Settings) -> DataFrame:
    """Tasks get whole logs in order and label them as they come, many small ones in a batch."""
    eps, min_samples = cfg.eps, cfg.min_cluster_size
    together = vectors.select("log_id", "ordinal", "embedding").repartition("log_id").sortWithinPartitions("log_id", "ordinal")
    return together.mapInArrow(
        lambda batches: density.labelled(batches, eps, min_samples),
        "log_id string, ordinal bigint, row bigint, label bigint, centrality double",
    )


def _points(vectors: DataFrame, cfg: Settings, stage: Stage) -> DataFrame:
    itself = (norm(F.col("embedding")) > 0) | F.lit(cfg.eps >= 1)
    return stage("points", vectors.select("log_id", "ordinal", "embedding", itself.alias("counts_itself"), F.floor(F.col("ordinal") / cfg.chunk_lines).alias("_chunk")))


def label_by_pairs(vectors: DataFrame, pairs: DataFrame, cfg: Settings, stage: Stage) -> DataFrame:
    """C6, C7 from a table of pairs (``log_id, a, b``): for logs of any size, and any ``min_cluster_size``."""
    points = _points(vectors, cfg, stage)
    return _described(points, components.density_labels(points, pairs, cfg.min_cluster_size, stage, cfg.chunk_lines), cfg, stage)


def label_by_blocks(
    vectors: DataFrame, cfg: Settings, stage: Stage, degrees: DataFrame | None = None, block_rows: int = similarity.BLOCK_ROWS
) -> DataFrame:
    """The same without a table of pairs, which is quadratic in the vectors of a log: vectors are compared block by block,
    once for the neighbour counts (``degrees``, if they are not there yet) and once for the links of core points; tables
    have a row per vector and two blocks at most, and ``min_cluster_size`` pairs per point that is no core point.
    """
    points = _points(vectors, cfg, stage)
    if degrees is None:
        degrees = stage("degrees", similarity.degrees(points, cfg.eps, stage, block_rows))
    core = stage("core_points", components.core_points(points, degrees, cfg.min_cluster_size))
    flagged = points.join(core.withColumn("core", F.lit(True)), ["log_id", "ordinal"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = stage("core_links", similarity.core_links(flagged, cfg.eps, stage, block_rows))
    borders = links.filter("border").select("log_id", F.col("a").alias("ordinal"), F.col("b").alias("other"))
    labels = components.linked_labels(points, core, links.filter("NOT border").drop("border"), borders, stage, cfg.chunk_lines)
    return _described(points, labels, cfg, stage)


def _described(points: DataFrame, labels: DataFrame, cfg: Settings, stage: Stage) -> DataFrame:
    """Labels with row numbers and, for members of clusters, how central they are."""
    alone = points.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("log_id", F.lit(0).cast("bigint").alias("_only"))
    rows = ordered.positions(points, ["log_id"], "_chunk", ["ordinal"], "row").withColumn("row", F.col("row") - 1)
    rows = rows.join(labels, ["log_id", "ordinal"]).join(alone, "log_id", "left").withColumn("label", F.coalesce("_only", "label"))
    members = stage("labelled", rows.select("log_id", "ordinal", "row", "label", "embedding"))
    # every cluster's mean, slot by slot, pre-aggregated in each task however large the cluster
    slots = members.filter("label >= 0").select("log_id", "label", F.posexplode("embedding").alias("slot", "x"))
    means = slots.groupBy("log_id", "label", "slot").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = means.groupBy("log_id", "label").agg(F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("s"))
    centre = stage("centres", centre.select("log_id", "label", F.col("s.x").alias("centre"), norm(F.col("s.x")).alias("far")))
    along = dot(F.col("embedding"), F.col("centre")) / F.when(F.col("far") > 0, F.col("far")).otherwise(1.0)
    return members.join(centre, ["log_id", "label"], "left").select(
        "log_id", "ordinal", "row", "label", F.when(F.col("centre").isNull(), 1.0).otherwise(along).alias("centrality")
    )


def label(vectors: DataFrame, cfg: Settings, stage: Stage | None = None, in_task: int = IN_TASK_ROWS) -> DataFrame:
    """``log_id, ordinal, row, label, centrality``; a log with a single vector gets label 0.

    ``stage`` writes a named frame and reads it back. Without it every log must have at most ``in_task`` vectors, as those
    of ``templates.prioritise`` under a cap of that size have; with it logs are counted, and larger ones go by pairs.
    """
    needed = vectors.select("log_id", F.col("ordinal").cast("bigint").alias("ordinal"), "embedding")
    if stage is None:
        return _label_in_tasks(needed, cfg)
    sizes = stage("vector_counts", needed.groupBy("log_id").agg(F.count(F.lit(1)).alias("n")))
    larger = sizes.filter(F.col("n") > in_task).select("log_id")
    if larger.isEmpty():
        return _label_in_tasks(needed, cfg)
    small = _label_in_tasks(needed.join(sizes.filter(F.col("n") <= in_task).select("log_id"), "log_id", "left_semi"), cfg)
    many = stage("many_vectors", needed.join(larger, "log_id", "left_semi"))
    return small.unionByName(label_by_blocks(many, cfg, stage))


def assign(kept: DataFrame, labels: DataFrame, large: bool = False) -> DataFrame:
    """The cluster id of every kept template, and the order in which clusters are emitted.

    ``large`` clusters get their first row by a join with their written labels, others within one window.
    """
    rows = kept.join(labels, ["log_id", "ordinal"])
    if large:
        rows = rows.join(labels.groupBy("log_id", "label").agg(F.min("row").alias("emitted")), ["log_id", "label"])
    else:
        rows = rows.withColumn("emitted", F.min("row").over(Window.partitionBy("log_id", "label")))
    noise = F.col("label") == -1
    return (
        rows.withColumn("cluster_id", F.when(noise, -1000 - F.col("row")).otherwise(F.col("label")))
        .withColumn("emitted_row", F.when(noise, F.col("row")).otherwise(F.lit(0)))
        .withColumn("stage", F.lit(1))
    )


def rollup(assigned: DataFrame) -> DataFrame:
    """A7 over templates: one row per log and cluster, with the message of its most central template."""
    most_central = F.struct(F.col("centrality"), -F.col("ordinal"))
    return assigned.groupBy("log_id", "cluster_id").agg(
        F.max_by("message", most_central).alias("representative_message"),
        F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.when(F.bool_or("critical"), "critical").otherwise("high").alias("severity"),
        F.min("stage").alias("stage"),
        F.min("emitted").alias("emitted"),
        F.min("emitted_row").alias("emitted_row"),
    )


def _single_errors(entries: DataFrame, cfg: Settings) -> DataFrame:
    """Logs with fewer errors than ``min_cluster_size`` give one cluster per error."""
    first = ordered.top(entries.filter(is_error()), ["log_id"], [F.col("line_number")], cfg.min_cluster_size)
    per_log = Window.partitionBy("log_id")
    index = F.row_number().over(per_log.orderBy("line_number"))
    few = first.withColumn("errors", F.count(F.lit(1)).over(per_log)).withColumn("index", index)
    few = few.filter(F.col("errors") < cfg.min_cluster_size)
    service = F.col("service")
    return few.select(
        "log_id",
        F.col("index").cast("bigint").alias("pos"),
        (-F.col("index")).cast("bigint").alias("cluster_id"),
        first_chars(F.col("message"), 500).alias("representative_message"),
        F.lit(1).cast("bigint").alias("count"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        F.when(F.col("level") == "CRITICAL", "high").otherwise("medium").alias("severity"),
        F.array(first_chars(F.col("message"), 300)).alias("sample_messages"),
        F.filter(F.array(service), lambda s: F.coalesce(s != "", F.lit(False))).alias("affected_services"),
    )


def error_clusters(
    entries: DataFrame,
    cfg: Settings,
    embed: Embedder | None = None,
    stage: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The ``max_clusters`` largest clusters of every log, in order (``pos`` from 1).

    ``embed`` adds an ``embedding`` column to templates (``log_id, ordinal, template, message, ...``). ``stage`` writes
    a named frame and reads it back; with it errors with their templates, templates and cluster members, each read
    several times, are made once.
    """
    embed = embed or hashed_embedder(cfg.vector_dims)
    capped = cfg.encode_cap is not None and cfg.encode_cap <= IN_TASK_ROWS
    if stage is None and not capped:
        raise ValueError(f"more than {IN_TASK_ROWS} templates of a log are compared by written tables: pass stage")
    by_size = None if capped else stage
    stage = stage or (lambda name, frame: frame)
    keyed = stage("keyed_errors", templates.keyed_errors(entries))
    found = stage("templates", templates.dedup(keyed, cfg, stage))
    enough = found.groupBy("log_id").agg(F.sum("count").alias("n")).filter(F.col("n") >= cfg.min_cluster_size)
    found = found.join(enough.select("log_id"), "log_id", "left_semi")
    kept = templates.prioritise(found, cfg)
    labels = label(embed(kept), cfg, by_size)
    assigned = assign(kept, labels if capped else stage("labels", labels), not capped)

    # only the largest of the left-out templates can become one of the largest clusters
    dropped = ordered.top(
        templates.left_out(found, kept), ["log_id"], [F.col("count").desc(), F.col("ordinal")], cfg.max_clusters
    )
    dropped = (
        dropped.withColumn("cluster_id", -3000 - F.col("ordinal"))
        .withColumn("centrality", F.lit(1.0))
        .withColumn("stage", F.lit(0))
        .withColumn("emitted", F.col("ordinal"))
        .withColumn("emitted_row", F.lit(0))
    )
    columns = [
        "log_id", "template", "ordinal", "message", "count", "first_seen", "last_seen", "critical",
        "cluster_id", "centrality", "stage", "emitted", "emitted_row",
    ]
    members = stage("cluster_members", assigned.select(*columns).unionByName(dropped.select(*columns)))
    order = [F.col("count").desc(), F.col("stage"), F.col("emitted"), F.col("emitted_row")]
    position = F.row_number().over(Window.partitionBy("log_id").orderBy(*order))
    largest = rollup(members).withColumn("pos", position)
    if cfg.max_clusters is not None:
        largest = largest.filter(F.col("pos") <= cfg.max_clusters)

    chosen = members.join(largest.select("log_id", "cluster_id"), ["log_id", "cluster_id"], "left_semi")
    belongs = keyed.join(chosen.select("log_id", "template", "cluster_id"), ["log_id", "template"])
    cluster = ["log_id", "cluster_id"]
    samples = (
        ordered.top(belongs, cluster, [F.col("line_number")], 3)
        .groupBy(*cluster)
        .agg(F.array_sort(F.collect_list(F.struct("line_number", first_chars(F.col("message"), 300)))).alias("s"))
        .select(*cluster, F.transform("s", lambda s: s["col2"]).alias("sample_messages"))
    )
    services = (
        ordered.top(
            belongs.filter(F.col("service") != "").select(*cluster, "service").distinct(),
            cluster,
            [F.col("service")],
            10,
        )
        .groupBy(*cluster)
        .agg(F.array_sort(F.collect_list("service")).alias("affected_services"))
    )
    none = F.array().cast("array<string>")
    regular = (
        largest.join(samples, cluster)
        .join(services, cluster, "left")
        .select(
            "log_id",
            F.col("pos").cast("bigint").alias("pos"),
            "cluster_id",
            first_chars(F.col("representative_message"), 500).alias("representative_message"),
            "count",
            "first_seen",
            "last_seen",
            "severity",
            "sample_messages",
            F.coalesce("affected_services", none).alias("affected_services"),
        )
    )
    return regular.unionByName(_single_errors(entries, cfg))


def p_level(severity: Column) -> Column:
    """F7."""
    s = F.lower(severity)
    return F.when(s == "critical", "P1").when(s == "high", "P2").when(s == "medium", "P3").otherwise("P4")


def search(found: DataFrame, text: str = "", p_levels: tuple[str, ...] = ()) -> DataFrame:
    """clusters by P-level and by text in the representative, the samples or the services."""
    if p_levels:
        found = found.filter(p_level(F.coalesce("severity", F.lit(""))).isin(*p_levels))
    if text:
        wanted = text.lower()

        def hit(column):
            return F.lower(column).contains(wanted)

        found = found.filter(
            F.coalesce(hit(F.col("representative_message")), F.lit(False))
            | F.exists("sample_messages", hit)
            | F.exists("affected_services", hit)
        )
    return found
