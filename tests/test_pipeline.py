import datetime as dt

import pytest

from faultline import Settings
from faultline.operators import evaluate
from faultline.plans import pipeline
from faultline.plans.staging import Staging, shared_folder
from faultline.sources import logs as sources

CFG = Settings(reference_time=dt.datetime(2024, 2, 1), default_year=2024)

ACCESS = '10.0.0.1 - - [15/Jan/2024:12:%02d:%02d +0000] "GET /api/%d HTTP/1.1" %d 0 "-" "-"'

LOGS = {
    "web": "\n".join([ACCESS % (m, s, s, 502 if m == 9 else 200) for m in range(10) for s in range(6)] + ["garbage"]),
    "app": "2024-01-15 12:00:00,000 ERROR x:1 boom\nTraceback (most recent call last):\n  File \"x\"\nZeroDivisionError: no\n",
    "host": "Jan 15 12:00:00 h kernel: Out of memory: Killed process 1\n<3>bad\n",
    "junk": "@@@ not a log @@@\n###\n",
    "empty": "",
}


@pytest.fixture(scope="module")
def results(spark):
    texts = spark.createDataFrame(list(LOGS.items()), "log_id string, text string")
    read = sources.from_texts(texts, CFG)
    cfg = pipeline.count_fleet(read.logs, CFG)
    assert cfg.fleet == len(LOGS)
    return pipeline.analyse(read.lines, cfg, logs=read.logs, staging=Staging(spark))


def test_summary(results):
    got = {r.log_id: r for r in results.summary.collect()}
    assert all(r.processing_time_ms > 0 for r in got.values())
    assert {k: r.log_source for k, r in got.items()} == {
        "web": "nginx", "app": "python", "host": "systemd", "junk": "unknown", "empty": "unknown",
    }
    assert (got["web"].total_lines, got["web"].parsed_lines, got["web"].skipped_lines) == (61, 60, 1)
    assert (got["empty"].total_lines, got["empty"].parsed_lines, got["empty"].error_rate) == (0, 0, 0.0)
    assert (got["junk"].parsed_lines, got["app"].parsed_lines) == (2, 2)
    assert {k: r.severity for k, r in got.items()} == {"web": "P3", "app": "P2", "host": "P1", "junk": "P4", "empty": "P4"}


def test_tables(results):
    causes = {(r.log_id, r.category) for r in results.root_causes.collect()}
    assert {("app", "code_error"), ("host", "memory"), ("web", "dependency"), ("empty", "dependency")} <= causes
    spikes = [(r.log_id, r.anomaly_type) for r in results.anomalies.collect()]
    assert spikes == [("web", "error_spike")]
    clusters = {(r.log_id, r["count"]) for r in results.error_clusters.collect()}
    assert ("web", 6) in clusters
    assert results.timeline.filter("log_id = 'web'").count() >= 2


def test_evaluation_of_a_run(spark, results):
    found = evaluate.outcomes(results.summary, results.anomalies, results.error_clusters, results.root_causes)
    cases = spark.createDataFrame(
        [("web", "nginx", ["error_spike"], "dependency", "P3", 1), ("host", "docker", [], "memory", "P1", 2)],
        "id string, expected_log_source string, expected_anomaly_types array<string>, "
        "expected_root_cause_category string, expected_severity string, expected_min_clusters int",
    ).selectExpr("*", "CAST(NULL AS boolean) AS expect_no_anomalies")
    out = evaluate.summary(evaluate.rows(cases, found)).first()
    assert (out.cases, out.log_source_accuracy, out.anomaly_type_recall, out.severity_accuracy) == (2, 0.5, 1.0, 1.0)


def test_declared_and_custom_formats(spark, lines):
    formats = spark.createDataFrame([("a", "mine"), ("b", "docker")], "log_id string, format string")
    both = lines("1|error|x\nnone", "a").unionByName(lines("s | 2024-01-15 12:00:00 ERROR y", "b"))
    custom = {"mine": r"^\d\|(?P<level>\w+)\|(?P<message>.*)$"}
    out = pipeline.analyse(both, CFG, formats, custom, staging=Staging(spark))
    got = {r.log_id: (r.log_source, r.parsed_lines, r.skipped_lines, r.error_rate) for r in out.summary.collect()}
    assert got == {"a": ("unknown", 2, 1, 0.5), "b": ("docker", 1, 0, 1.0)}


def test_staging_uses_the_named_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert Staging(spark).folder.startswith(shared_folder(spark))


@pytest.mark.parametrize("bad", [{"encode_cap": 0}, {"timeline_cap": 0}, {"chunk_lines": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
