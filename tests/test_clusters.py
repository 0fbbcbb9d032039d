import random

import numpy as np
import pytest
from conftest import entry
from pyspark.sql import functions as F

from faultline import Settings
from faultline.functions import density, vectors
from faultline.operators import clusters, components, similarity, templates
from faultline.plans.staging import Staging

CFG = Settings()


def same_vector(frame):
    return frame.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))


def by_word(frame):
    oom = F.col("template").contains("oom")
    return frame.withColumn("embedding", F.when(oom, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))


@pytest.mark.parametrize(
    "message, template",
    [
        ("User 42 at 10.0.0.1 FAILED", "user <NUM> at <IP> failed"),
        ("id 0f8fad5b-d9cb-469f-a165-70867728950e ok", "id <ID> ok"),
        ("open /var/log/app-7.log  now", "open <PATH> now"),
        (r"open C:\temp\x.txt now", "open <PATH> now"),
        ("hash " + "ab" * 16 + " ok", "hash <ID> ok"),
        ("hash " + "ab" * 15 + " ok", "hash " + "ab" * 15 + " ok"),
        ("999.1.1.1", "<NUM>.<NUM>.<NUM>.<NUM>"),
    ],
)
def test_normalise(spark, message, template):
    row = spark.createDataFrame([(message,)], "m string").select(templates.normalise(F.col("m"))).first()
    assert row[0] == template


def test_tiers(spark):
    rows = ["an Error", "[crit x", "request refused", "hello"]
    frame = spark.createDataFrame([(r,) for r in rows], "m string").select(templates.tier(F.col("m")))
    assert [r[0] for r in frame.collect()] == [0, 0, 1, 2]


def test_same_errors_form_one_cluster(entries):
    rows = [entry(i, "refused to host:5432", "ERROR", service=f"s{i % 12:02d}") for i in range(1, 31)]
    found = clusters.error_clusters(entries(rows), CFG, same_vector).collect()
    assert [(c.cluster_id, c["count"], c.severity) for c in found] == [(0, 30, "high")]
    assert found[0].affected_services == [f"s{i:02d}" for i in range(10)]
    assert found[0].sample_messages == ["refused to host:5432"] * 3 and found[0].first_seen is None


def test_distinct_errors_stay_apart(entries):
    rows = [entry(1, "OOMKilled", "ERROR"), entry(2, "certificate expired", "CRITICAL", ts=5)]
    found = clusters.error_clusters(entries(rows), CFG, by_word).orderBy("pos").collect()
    assert [(c.cluster_id, c.severity) for c in found] == [(-1000, "high"), (-1001, "critical")]


def test_single_error(entries):
    found = clusters.error_clusters(entries([entry(7, "boom", "ERROR", service="s")]), CFG, same_vector).collect()
    assert [(c.cluster_id, c["count"], c.severity, c.affected_services) for c in found] == [(-1, 1, "medium", ["s"])]
    assert clusters.error_clusters(entries([entry(7, "fine")]), CFG, same_vector).count() == 0


def test_left_out_templates_keep_their_counts(entries):
    rows = [entry(i, f"word{'x' * (i % 5)} happened", "ERROR") for i in range(1, 41)]
    cfg = CFG.but(encode_cap=2, max_clusters=4)
    found = clusters.error_clusters(entries(rows), cfg, same_vector).orderBy("pos").collect()
    assert [c["count"] for c in found] == [16, 8, 8, 8]
    assert [c.cluster_id for c in found] == [0, -3002, -3003, -3004]


def test_all_clusters_without_a_cap(entries):
    rows = [entry(i, f"word{'x' * i} happened", "ERROR") for i in range(1, 21)]
    found = clusters.error_clusters(entries(rows), CFG.but(encode_cap=2, max_clusters=None), same_vector)
    assert sorted(c["count"] for c in found.collect()) == [1] * 18 + [2]


def brute(points, eps, min_samples):
    """Textbook density clustering, one point at a time."""
    near = [[j for j, q in enumerate(points) if 1 - p @ q <= eps] for p in points]
    labels, current = [-1] * len(points), -1
    for i in range(len(points)):
        if labels[i] != -1 or len(near[i]) < min_samples:
            continue
        current += 1
        labels[i], queue = current, list(near[i])
        while queue:
            j = queue.pop()
            if labels[j] == -1:
                labels[j] = current
                if len(near[j]) >= min_samples:
                    queue += near[j]
    return labels


@pytest.mark.parametrize("min_samples", [1, 2, 3, 5])
def test_density_labels_against_a_walk(min_samples):
    rng = np.random.default_rng(min_samples)
    for _ in range(60):
        points = rng.normal(size=(rng.integers(1, 40), 4))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        eps = rng.uniform(0.05, 0.6)
        assert density.density_labels(density.distances(points) <= eps, min_samples).tolist() == brute(points, eps, min_samples)


def points_frame(spark, logs):
    rows = [(name, i, [float(x) for x in p]) for name, points in logs.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "log_id string, ordinal long, embedding array<double>")


@pytest.mark.parametrize("min_samples", [1, 2, 4])
def test_labels_by_pairs_equal_those_in_tasks(spark, min_samples):
    rng, logs = np.random.default_rng(min_samples), {}
    for name, size, dims in (("a", 300, 4), ("b", 1, 4), ("c", 40, 3), ("d", 2, 4), ("hot", 200, 4)):
        points = rng.normal(size=(size, dims))
        if name == "hot":
            points[:120] = points[0]
        points[:: 50 if size > 50 else 1_000] *= size <= 50
        logs[name] = points
    frame, cfg = points_frame(spark, logs), CFG.but(eps=0.06, min_cluster_size=min_samples)
    want = clusters.label(frame, cfg).collect()
    got = clusters.label(frame, cfg, Staging(spark).table, 30).collect()
    plain = lambda rows: sorted((r.log_id, r.ordinal, r.row, r.label, round(r.centrality, 6)) for r in rows)
    assert plain(got) == plain(want) and len({r.label for r in want}) > 3


def test_labels_of_a_log_above_any_task(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(2_600, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    for min_samples in (2, 4):
        found = clusters.label(points_frame(spark, {"a": points}), CFG.but(eps=8e-4, min_cluster_size=min_samples), Staging(spark).table)
        want = density.density_labels(density.distances(points) <= 8e-4, min_samples).tolist()
        assert [r.label for r in found.orderBy("ordinal").collect()] == want and max(want) > 20


@pytest.mark.parametrize("block_rows", [7, 1_000])
def test_pairs_in_blocks_are_all_pairs(spark, block_rows):
    rng = np.random.default_rng(2)
    logs = {"a": rng.normal(size=(90, 5)), "b": rng.normal(size=(1, 5)), "c": np.zeros((3, 5))}
    frame = points_frame(spark, logs).unionByName(spark.createDataFrame([("a", 500, None)], "log_id string, ordinal long, embedding array<double>"))
    want = set()
    for name, points in logs.items():
        near = density.distances(points) <= 0.3
        want |= {(name, i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if near[i, j]}
    found = similarity.all_pairs(frame, 0.3, Staging(spark).table, block_rows).collect()
    assert {(r.log_id, r.a, r.b) for r in found} == want and len(found) == len(want)


def test_hyperplanes_find_nearly_all_pairs_once(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    points = np.vstack([c + rng.normal(scale=0.45, size=(12, 24)) for c in centres] + [centres[:1]] * 150)
    near = np.triu(density.distances(points) <= 0.3, k=1)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}
    found = [(r.a, r.b) for r in similarity.likely_pairs(points_frame(spark, {"a": points}), 0.3, Staging(spark).table, 5, 0.95, 60).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.95 * len(want)


def test_components_of_chains_per_log(spark):
    pairs = [("a", i, i + 1) for i in range(50)] + [("b", 7, 3), ("b", 3, 9), ("b", 100, 101)]
    found = components.roots(spark.createDataFrame(pairs, "log_id string, a long, b long"), Staging(spark).table).collect()
    assert {(r.log_id, r.node): r.root for r in found} == {("a", i): 0 for i in range(51)} | {("b", n): 3 for n in (3, 7, 9)} | {("b", 100): 100, ("b", 101): 100}


def test_clusters_of_all_templates(spark, entries):
    rows = [entry(i, f"word{'x' * (i % 30)} happened", "ERROR") for i in range(1, 91)] + [entry(100, "oom now", "ERROR")]
    cfg = CFG.but(encode_cap=None)
    with pytest.raises(ValueError, match="stage"):
        clusters.error_clusters(entries(rows), cfg, by_word)
    want = [tuple(r) for r in clusters.error_clusters(entries(rows), CFG, by_word).orderBy("pos").collect()]
    small = clusters.IN_TASK_ROWS
    try:
        for clusters.label.__defaults__ in ((None, small), (None, 5)):
            got = clusters.error_clusters(entries(rows), cfg, by_word, Staging(spark).table).orderBy("pos").collect()
            assert [tuple(r) for r in got] == want and [r["count"] for r in got] == [90, 1]
    finally:
        clusters.label.__defaults__ = (None, small)


def test_default_embedding(spark):
    texts = ["worker <NUM> timed out", "worker <NUM> timed out again", "disk full on <PATH>", "<NUM>"]
    frame = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "log_id string, ordinal long, template string")
    found = [np.array(r.embedding) for r in vectors.hashed_embedder(64)(frame).orderBy("ordinal").collect()]
    assert [round(float(np.linalg.norm(v)), 5) for v in found] == [1.0, 1.0, 1.0, 0.0]
    assert found[0] @ found[1] > 0.8 and found[0] @ found[2] < 0.5


def test_default_embedding_merges_like_messages(entries):
    rng = random.Random(1)
    rows = [entry(i, f"connection to shard alpha {rng.randint(0, 99)} lost {'again' if i % 2 else ''}", "ERROR") for i in range(1, 21)]
    rows += [entry(100 + i, "quota exceeded", "ERROR") for i in range(3)]
    found = clusters.error_clusters(entries(rows), CFG).orderBy("pos").collect()
    assert [c["count"] for c in found] == [20, 3]


def test_search(entries):
    rows = [entry(i, "disk Full", "CRITICAL", service="Store") for i in range(3)]
    found = clusters.error_clusters(entries(rows), CFG, same_vector)
    assert clusters.search(found, "FULL", ("P1",)).count() == 1
    assert clusters.search(found, "store").count() == 1
    assert clusters.search(found, "full", ("P2", "P4")).count() == 0
    assert clusters.search(found, "absent").count() == 0


@pytest.mark.parametrize("min_samples", [4])
def test_labels_by_blocks_equal_those_by_pairs(spark, min_samples):
    rng = np.random.default_rng(min_samples)
    logs = {}
    for name, n in (("a", 30), ("b", 60), ("c", 1)):
        points = rng.normal(size=(n, 3))
        if n > 10:
            points[3] = points[n - 1] = 0.0
            points[7] = points[8]
        logs[name] = points
    frame, cfg = points_frame(spark, logs), Settings(eps=0.03, min_cluster_size=min_samples)
    pairs = clusters.edges(frame, cfg, Staging(spark).table, 7).select("log_id", "a", "b")

    def plain(found):
        return sorted((r.log_id, r.ordinal, r.row, r.label, round(r.centrality, 6)) for r in found.collect())

    want = plain(clusters.label_by_pairs(frame, pairs, cfg, Staging(spark).table))
    assert plain(clusters.label_by_blocks(frame, cfg, Staging(spark).table, None, 20)) == want


def test_counts_of_pairs_leave_no_pairs_behind(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    points = np.vstack([centre + 0.4 * rng.normal(size=(30, 24)) for centre in centres])
    frame = points_frame(spark, {"a": points, "b": points[:50]})
    for counted, listed in (
        (similarity.count_pairs(frame, 0.3, Staging(spark).table, 60), similarity.all_pairs(frame, 0.3, Staging(spark).table, 60)),
        (similarity.count_likely_pairs(frame, 0.3, Staging(spark).table, 5, 0.95, 60), similarity.likely_pairs(frame, 0.3, Staging(spark).table, 5, 0.95, 60)),
    ):
        want = {r["log_id"]: r["count"] for r in listed.groupBy("log_id").count().collect()}
        assert {r.log_id: r.pairs for r in counted.collect()} == want and len(want) == 2


def test_large_logs_are_dealt_into_large_blocks(spark):
    # copies of a vector go with its blocks: sixteen of them, not one per thousand vectors
    frame = spark.range(40_000).select(F.lit("a").alias("log_id"), F.col("id").alias("ordinal"), F.array(F.lit(1.0)).alias("embedding"))
    cells = similarity._whole_logs(frame, Staging(spark).table, "blocks", 128)
    assert cells.filter("ordinal = 7").count() == 16 and cells.select("block").distinct().count() == 16
    larger = similarity._cells(frame.withColumn("number", F.lit(0)).withColumn("bucket", F.lit(0)), Staging(spark).table, "larger", 128, 1)
    assert larger.select("block").distinct().count() == 3


def test_logs_are_labelled_as_they_come_however_batches_cut_them():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sizes = [1, 3, 1, 40, 2, 7, 1, 1]
    points = rng.normal(size=(sum(sizes), 4)).astype(np.float32)
    ids = [f"log-{i}" for i, n in enumerate(sizes) for _ in range(n)]
    ordinals = [5 * i for n in sizes for i in range(n)]
    rows = pa.table({"log_id": ids, "ordinal": ordinals, "embedding": pa.array(points.tolist(), pa.list_(pa.float32()))})
    want, at = [], 0
    for n in sizes:
        labels, centrality = density.label_matrix(points[at : at + n].astype(np.float64), 0.5, 2)
        want += zip(ids[at : at + n], ordinals[at : at + n], range(n), labels.tolist(), centrality.tolist())
        at += n
    for width in (1, 3, 10, 100):
        made = pa.Table.from_batches(density.labelled(iter(rows.to_batches(width)), 0.5, 2))
        assert list(zip(*made.to_pydict().values(), strict=True)) == want
    assert list(density.labelled(iter([]), 0.5, 2)) == []


def test_small_logs_share_a_python_call(spark):
    rows = [(f"l{i % 50:02d}", i, [1.0, float(i % 3)]) for i in range(150)]
    labels = clusters.label(spark.createDataFrame(rows, "log_id string, ordinal bigint, embedding array<float>"), CFG)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert labels.count() == 150 and {r.row for r in labels.collect()} == {0, 1, 2}
