"""Sources, stored results, history, evaluation."""

import bz2
import datetime as dt
import gzip
import json

import pytest
from conftest import BASE, entry

from faultline import Settings
from faultline.operators import evaluate, history
from faultline.schema import EVAL_CASES, HISTORY, ddl
from faultline.sources import logs, reports

CFG = Settings(reference_time=dt.datetime(2024, 2, 1))

TEXTS = {
    "plain.log": "a\nb\nc",
    "closed.log": "a\nb\n",
    "odd.log": "a\r\nb\rc\x0bd\x85e\u2028f\n\n\x1cg\n",
    "only_odd.log": "\x0c\nx\x0c",
    "bad_bytes.log": None,
    "empty.log": "",
}
BAD = b"ok \xff\xfe tail\nnext \xe2\x82\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for name, text in TEXTS.items():
        (root / name).write_bytes(BAD if text is None else text.encode())
    return root


def expected(name):
    text = BAD.decode("utf-8", errors="replace") if TEXTS[name] is None else TEXTS[name]
    return list(enumerate(text.splitlines(), 1))


def by_file(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.log_id.rsplit("/", 1)[-1], []).append((r.line_number, r.raw_line))
    return {name: sorted(rows) for name, rows in out.items()}


def test_lines_of_small_files(spark, folder):
    read = logs.read(spark, str(folder), CFG)
    found = by_file(read.lines)
    for name in TEXTS:
        assert found.get(name, []) == expected(name)
    assert read.logs.count() == len(TEXTS) - 1 and read.quarantine.count() == 0


def test_lines_of_large_files(spark, folder, tmp_path):
    found = by_file(logs.large_file_lines(spark, str(folder)))
    for name in TEXTS:
        assert found.get(name, []) == expected(name)

    big = [f"line {i}" + ("\x0btwo" if i % 5000 == 7 else "") for i in range(60_000)]
    (tmp_path / "big.log").write_text("\n".join(big) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        frame = logs.large_file_lines(spark, str(tmp_path))
        assert frame.count() == 60_012
        assert by_file(frame)["big.log"] == list(enumerate("\n".join(big).splitlines(), 1))
    finally:
        spark.conf.set(key, before)


def test_guards(spark, folder):
    read = logs.read(spark, str(folder), CFG.but(max_bytes=12, max_line_breaks=1))
    why = {r.log_id.rsplit("/", 1)[-1]: r.reason for r in read.quarantine.collect()}
    assert why == {
        "odd.log": "file_too_large", "bad_bytes.log": "file_too_large", "plain.log": "too_many_lines",
        "closed.log": "too_many_lines",
    }
    assert set(by_file(read.lines)) == {"only_odd.log"}


def test_routes_agree_on_ids_lines_and_guards(spark, tmp_path):
    made = {
        "a b+c%.log": "x\r\ny\rz\x0b", "open.log": "x\ny\r", "closed.log": "x\r\r\n\n", "one.log": "\n", "ends.log": "x\ny\x0b",
        "mark.log": "a\n\u2028b\x85",
    }
    for name, text in made.items():
        (tmp_path / name).write_bytes(text.encode())

    def seen(cfg):
        read = logs.read(spark, str(tmp_path), cfg)
        tables = (read.lines, read.logs, read.quarantine)
        return [sorted(map(tuple, t.collect())) for t in tables]

    for cfg in (CFG, CFG.but(max_line_breaks=1), CFG.but(max_bytes=7), CFG.but(max_bytes=5, max_line_breaks=1)):
        assert seen(cfg.but(whole_file_bytes=1)) == seen(cfg.but(whole_file_bytes=4)) == seen(cfg)
    lines, ids, _ = seen(CFG.but(whole_file_bytes=1))
    assert {i[0].rsplit("/", 1)[-1] for i in ids} == set(made)
    for name, text in made.items():
        assert [x[2] for x in lines if x[0].endswith(name)] == text.splitlines()


def test_compressed_files_are_read_alike_at_every_size(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(1_000)) + "odd\x0bends\r\nno end"
    for name, pack in (("a.log.gz", gzip.compress), ("b.log.bz2", bz2.compress), ("c.log", lambda b: b)):
        (tmp_path / name).write_bytes(pack(text.encode()))
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"first\n") + gzip.compress(b"second\n"))
    for size in (1, 10_000, 64 << 20):
        found = by_file(logs.read(spark, str(tmp_path), CFG.but(whole_file_bytes=size)).lines)
        for name in ("a.log.gz", "b.log.bz2", "c.log"):
            assert found[name] == list(enumerate(text.splitlines(), 1)), (name, size)
        assert found["two.gz"] == [(1, "first"), (2, "second")]
    guarded = logs.read(spark, str(tmp_path), CFG.but(max_line_breaks=900))
    assert {r.log_id.rsplit("/", 1)[-1] for r in guarded.quarantine.collect()} >= {"a.log.gz", "b.log.bz2", "c.log"}
    assert {r.log_id.rsplit("/", 1)[-1] for r in guarded.lines.select("log_id").distinct().collect()} == {"two.gz"}


def test_lines_of_large_files_are_not_shuffled(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(50_000)))
    frame = logs.large_file_lines(spark, str(tmp_path))
    assert frame.count() == 50_000
    frame.write.format("noop").mode("overwrite").save()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan and plan.count("FileScan text") == 1


def test_guards_are_off_by_default():
    assert CFG.max_bytes is None and CFG.max_line_breaks is None


def test_both_routes_together(spark, folder):
    read = logs.read(spark, str(folder), CFG.but(max_bytes=None, max_line_breaks=None, whole_file_bytes=6))
    found = by_file(read.lines)
    for name in TEXTS:
        assert found.get(name, []) == expected(name)
    assert sorted(r.log_id for r in read.logs.collect()) == sorted({r.log_id for r in read.lines.collect()})


def test_reports_round_trip(spark, tmp_path):
    made = spark.createDataFrame(
        [(f"l{i}", "P2", ("nginx", i, f"2024-01-{i:02d}")) for i in range(1, 8)],
        "log_id string, severity string, metadata struct<log_source string, total_lines long, generated_at string>",
    )
    path = str(tmp_path / "reports")
    reports.save(made, path)
    (tmp_path / "reports" / "part-broken.json").write_text("{not json\n")
    found = reports.latest(spark, path, CFG.but(listing_rows=50)).collect()
    assert len(found) == 7 and {len(r.id) for r in found} == {12}
    assert reports.latest(spark, path, CFG.but(listing_rows=3)).count() <= 3
    assert set(found[0].asDict()) == {"id", "severity", "log_source", "total_lines", "generated_at"}


def test_cluster_csv(spark, tmp_path):
    made = spark.createDataFrame(
        [("a", 3, "high", 2, 'said "x", twice', BASE, None, ["s1", "s2"])],
        "log_id string, cluster_id long, severity string, count long, representative_message string, "
        "first_seen timestamp_ntz, last_seen timestamp_ntz, affected_services array<string>",
    )
    reports.export_clusters(made, str(tmp_path / "csv"))
    text = next((tmp_path / "csv" / "log_id=a").glob("*.csv")).read_text()
    assert text.splitlines() == [
        "Cluster ID,Severity,Count,Message,First Seen,Last Seen,Services",
        '3,high,2,"said ""x"", twice",2024-01-15T12:00:00,"",s1; s2',
    ]


def test_evaluation_cases_and_results(spark, tmp_path):
    cases = [{"id": f"c{i}", "log_text": "x", "expected_anomaly_types": []} for i in range(20)]
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=1))
    read = reports.eval_cases(spark, str(tmp_path / "cases.json"), CFG)
    assert [r.id for r in read.collect()] == [f"c{i}" for i in range(15)]
    one = spark.createDataFrame([(1, 0.5)], "cases long, severity_accuracy double")
    reports.save_evaluation(one, read.select("id"), str(tmp_path / "out"), CFG)
    assert spark.read.json(str(tmp_path / "out" / "summary")).first().run == "20240201_000000"
    assert spark.read.json(str(tmp_path / "out" / "rows")).count() == 15


def test_evaluation_figures(spark):
    cases = spark.createDataFrame(
        [
            ("1", None, None, "nginx", ["silence", "error_spike"], "memory", "P1", 1, None),
            ("2", None, None, "python", [], "network", "P4", 0, True),
            ("3", None, None, "docker", None, "network", "P2", None, None),
        ],
        ddl(EVAL_CASES),
    )
    found = spark.createDataFrame(
        [
            ("1", 10.0, "nginx", "P1", ["silence"], ["memory", "network"], 1, 1),
            ("2", 20.0, "python", "P3", ["silence"], ["dependency"], 0, 4),
            ("3", 60.0, "unknown", "P2", [], ["network"], 0, 0),
        ],
        "id string, elapsed_ms double, log_source string, severity string, anomaly_types array<string>, "
        "root_categories array<string>, cluster_count long, anomaly_count long",
    )
    out = evaluate.summary(evaluate.rows(cases, found)).first()
    assert out.cases == 3 and out.log_source_accuracy == pytest.approx(2 / 3)
    assert out.anomaly_type_recall == 0.5 and out.root_cause_category_accuracy == pytest.approx(2 / 3)
    assert out.severity_accuracy == pytest.approx(2 / 3) and out.cluster_detection_rate == 1.0
    assert out.false_positive_rate == pytest.approx(1 / 3) and out.avg_processing_time_ms == 30.0
    empty = evaluate.summary(evaluate.rows(cases.limit(0), found)).first()
    assert empty.cases == 0 and empty.anomaly_type_recall == 0.0 and empty.false_positive_rate == 0.0


def make_history(spark, rows):
    full = [
        (str(i), BASE - dt.timedelta(days=i), f"t{i}", sev, src, 10, 1, 2, mark) for i, (sev, src, mark) in enumerate(rows)
    ]
    return spark.createDataFrame(full, ddl(HISTORY))


def test_history(spark):
    rows = make_history(spark, [("P1", "nginx", True), ("P1", "nginx", False), ("P2", "docker", False), ("P9", "x", True)])
    assert {r.severity: r.analyses for r in history.by_severity(rows).collect()} == {"P1": 2, "P2": 1, "P9": 1}
    assert [r.log_source for r in history.by_source(rows).collect()] == ["nginx", "docker", "x"]
    assert history.totals(rows).first().total_lines == 40
    assert [(r.day, r.serious) for r in history.daily(rows).collect()][-1] == ("2024-01-15", 1)
    assert history.average_severity(rows).first().severity == "P2"
    assert history.average_severity(rows.limit(0)).first().severity == "—"
    assert [r.id for r in history.search(rows, "NGINX", "P1", True).collect()] == ["0"]
    newest = history.append(rows.filter("id > '0'"), rows.filter("id = '0'"), CFG.but(listing_rows=2)).collect()
    assert [r.id for r in newest] == ["0", "1"]


def test_service_metrics(spark):
    runs = spark.createDataFrame([("nginx", 10.0), ("nginx", 20.0), ("python", 60.0)], "log_source string, processing_time_ms double")
    out = history.service_metrics(runs, CFG).first()
    assert (out.total_requests, out.avg_processing_time_ms, out.format_distribution) == (3, 30.0, {"nginx": 2, "python": 1})
    assert history.service_metrics(runs.limit(0), CFG).first().avg_processing_time_ms == 0.0
    assert entry(1)["metadata"] == {}
