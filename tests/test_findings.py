"""Timeline, root causes, severity, reports."""

import datetime as dt
import json

import pytest
from conftest import BASE, entry

from faultline import Settings
from faultline.operators import anomalies, report, root_causes, summary, timeline
from faultline.plans import pipeline
from faultline.plans.staging import Staging

CFG = Settings(reference_time=dt.datetime(2024, 2, 1))


def build(entries, rows, no_anomalies, cfg=CFG):
    return timeline.build(entries(rows), no_anomalies, cfg).orderBy("pos").collect()


def test_timeline_is_sorted_with_unknown_times_first(entries, no_anomalies):
    rows = [entry(1, "a", "ERROR", ts=2), entry(2, "b", "ERROR", ts=1), entry(3, "c", "ERROR")]
    found = build(entries, rows, no_anomalies)
    assert [e.description for e in found] == ["c", "b", "a"] and [e.pos for e in found] == [1, 2, 3]


def test_no_cap_keeps_every_event_in_order(entries, no_anomalies, spark):
    rows = [entry(i, f"{i} broke", "ERROR", ts=None if i % 50 == 0 else 300 * (i % 7)) for i in range(1, 151)]
    want = sorted(rows, key=lambda r: (r["ts"] is not None, r["ts"] or 0, r["line_number"]))
    for stage in (None, Staging(spark).table):
        found = timeline.build(entries(rows), no_anomalies, CFG.but(timeline_cap=None), stage).orderBy("pos").collect()
        assert [e.related_entries for e in found] == [[r["line_number"]] for r in want]
        assert [e.pos for e in found] == list(range(1, 151))
    staged = timeline.build(entries(rows), no_anomalies, CFG, Staging(spark).table)
    assert staged.collect() == timeline.build(entries(rows), no_anomalies, CFG).collect() and staged.count() == 100


def test_one_entry_may_emit_several_events(entries, no_anomalies):
    rows = [entry(1, "container OOMKilled, starting again", "CRITICAL", ts=1)]
    found = build(entries, rows, no_anomalies)
    assert [e.event_type for e in found] == ["first_error", "critical", "service_restart", "resource"]
    assert [e.severity for e in found] == ["high", "critical", "low", "critical"]


def test_first_errors_share_a_start_of_120_characters(entries, no_anomalies):
    same = "x" * 120
    rows = [entry(i, same + str(i), "ERROR", ts=i) for i in range(5)] + [entry(9, "x" * 119, "ERROR", ts=9)]
    assert [e.related_entries for e in build(entries, rows, no_anomalies)] == [[0], [9]]


@pytest.mark.parametrize("cap, kept", [(5, [0, 1, 997, 998, 999]), (1, [999]), (4, [0, 1, 998, 999])])
def test_timeline_keeps_both_ends(entries, no_anomalies, cap, kept):
    rows = [entry(i, f"e{i}", "ERROR", ts=i) for i in range(1000)]
    found = build(entries, rows, no_anomalies, CFG.but(timeline_cap=cap))
    assert [e.related_entries[0] for e in found] == kept


@pytest.mark.parametrize("size", [4, 5, 6])
def test_timeline_at_its_cap(entries, no_anomalies, size):
    rows = [entry(i, f"e{i}", "ERROR", ts=i) for i in range(size)]
    found = build(entries, rows, no_anomalies, CFG.but(timeline_cap=5))
    assert [e.related_entries[0] for e in found] == ([0, 1, 3, 4, 5] if size == 6 else list(range(size)))


@pytest.mark.parametrize("plain_between, line", [(0, 2), (4, 6), (5, None)])
def test_recovery_within_five_entries(entries, plain_between, line):
    rows = [entry(1, "bad", "ERROR", ts=0)]
    rows += [entry(2 + i, "w", "WARNING", ts=700 * (1 + i)) for i in range(plain_between)]
    rows += [entry(2 + plain_between, "ok", ts=700 * (1 + plain_between)), entry(50, "ok", ts=90_000)]
    found = timeline.recoveries(entries(rows), CFG).collect()
    assert [r.line_number for r in found] == ([line] if line else [])


def test_recovery_against_a_walk(entries):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for log in range(60):
        seq = [rng.choice(["INFO", "ERROR", "WARNING", "WARNING", "WARNING"]) for _ in range(25)]
        span = 9000 if log % 2 else 6
        times = sorted(rng.randint(0, span) for _ in seq)
        rows += [entry(i, level=lv, ts=t, log_id=f"l{log}") for i, (lv, t) in enumerate(zip(seq, times))]
        for i, level in enumerate(seq):
            if level == "INFO" and "ERROR" in seq[max(0, i - 5) : i]:
                want[f"l{log}"] = i
                break
    got = {r.log_id: r.line_number for r in timeline.recoveries(entries(rows), CFG).collect()}
    assert got == want


def causes(entries, *rows):
    return root_causes.analyse(entries(list(rows))).orderBy("pos").collect()


@pytest.mark.parametrize(
    "message, category, confidence",
    [
        ("password authentication failed for x", "database", "medium"),
        ("Connection refused to db:5432", "database", "medium"),
        ("Connection refused to db:54321", "dependency", "low"),
        ("OOMKilled", "memory", "high"),
        ("GET /x 503", "dependency", "medium"),
        ("GET /x 15030", "dependency", "low"),
        ("No space left on device", "resource_exhaustion", "high"),
        ("FileNotFoundError: /etc/a.yaml", "configuration", "medium"),
        ("Unhandled Exception in x", "code_error", "medium"),
        ("TLS handshake error", "network", "medium"),
        ("all fine", "dependency", "low"),
    ],
)
def test_each_rule(entries, message, category, confidence):
    found = causes(entries, entry(1, message, "ERROR", ts=3))
    assert [(c.category, c.confidence) for c in found] == [(category, confidence)]


def test_signals_of_one_rule_may_come_from_different_entries(entries):
    found = causes(entries, entry(1, "connection refused", ts=9), entry(2, "at :3306", ts=1), entry(3, "too many connections"))
    assert found[0].category == "database" and found[0].confidence == "high"
    assert found[0].evidence == ["connection refused to DB port", "too many connections"]
    assert found[0].first_signal_at == BASE + dt.timedelta(seconds=9)
    assert [c.category for c in causes(entries, entry(1, "killed"), entry(2, "oom"))] == ["memory"]
    assert causes(entries, entry(1, "killed"), entry(2, "oom"))[0].evidence == ["OOM-related signals in logs"]


def test_quoted_evidence_is_the_first_three_in_order(entries):
    rows = [entry(i, "x", "ERROR") for i in range(50)]
    rows += [entry(60, "MemoryError then Out of memory", "ERROR"), entry(55, "oomkilled", "ERROR"), entry(70, "oomkilled")]
    assert causes(entries, *rows)[0].evidence == ["oomkilled", "memoryerror", "out of memory"]


def test_ranking(entries):
    rows = [
        entry(1, "dns resolution failed", ts=1),
        entry(2, "invalid configuration", ts=0),
        entry(3, "x", stack_trace="Traceback", ts=None),
        entry(4, "no space left on device", ts=50),
    ]
    found = causes(entries, *rows)
    assert [c.category for c in found] == ["resource_exhaustion", "code_error", "configuration", "network"]


def test_logs_without_entries_get_the_fallback(spark, entries):
    logs = spark.createDataFrame([("a",), ("b",)], "log_id string")
    found = root_causes.analyse(entries([entry(1, "OOMKilled")]), logs).collect()
    assert {(c.log_id, c.category) for c in found} == {("a", "memory"), ("b", "dependency")}


@pytest.mark.parametrize(
    "critical, rate, cascade, confidence, grade",
    [
        (1, 0.0, None, "high", "P1"),
        (1, 0.0, None, "medium", "P4"),
        (0, 0.11, None, "high", "P2"),
        (0, 0.0, "cascade_failure", "low", "P2"),
        (0, 0.1, None, "low", "P3"),
        (0, 0.0, "silence", "low", "P3"),
        (0, 0.02, None, "low", "P4"),
    ],
)
def test_grades(spark, no_anomalies, critical, rate, cascade, confidence, grade):
    totals = spark.createDataFrame([("a", critical, rate)], "log_id string, critical_count long, error_rate double")
    found = no_anomalies.select("log_id", "anomaly_type")
    if cascade:
        found = found.union(spark.createDataFrame([("a", cascade)], "log_id string, anomaly_type string"))
    rules = spark.createDataFrame([("a", confidence)], "log_id string, confidence string")
    assert summary.grade(totals, found, rules).first().severity == grade


def test_summary_figures(entries):
    rows = [entry(i, f"m{i % 7}", "ERROR", ts=i) for i in range(20)] + [entry(30, "w", "WARNING"), entry(31, "c", "CRITICAL")]
    out = summary.log_summary(entries(rows), CFG).first()
    assert out.top_error_messages == ["m0", "m1", "m2", "m3", "m4", "m5"][:5]
    assert (out.parsed_lines, out.critical_count) == (22, 1)
    assert out.error_rate == pytest.approx(21 / 22) and out.time_range.end == BASE + dt.timedelta(seconds=19)


@pytest.fixture(scope="module")
def found(spark, entries):
    rows = [entry(i, "GET /x 502 upstream timed out", "ERROR", ts=i, service="web") for i in range(6)]
    rows += [entry(10 + i, "fine", ts=60 * (i + 1)) for i in range(30)] + [entry(99, 'said "hi"', "CRITICAL")]
    rows += [entry(1, "quiet", log_id="b", ts=0)]
    cfg = CFG.but(z_threshold=2.0)
    return pipeline.findings(pipeline.analyse_entries(entries(rows), cfg, staging=Staging(spark)), cfg)


def test_markdown(found):
    texts = {r.log_id: r.report for r in report.markdown(found, CFG).collect()}
    assert texts["a"].startswith("# Incident Report\n\n- **generated_at:** 2024-02-01T00:00:00.000000Z\n")
    for title in ("Incident Summary", "Timeline", "Root Cause Analysis", "Impact Assessment", "Prevention"):
        assert f"## {title}\n" in texts["a"]
    assert "Automated analysis of **37** log lines (unknown), **37** structured entries. Error rate **18.9%**" in texts["a"]
    assert "- 0001-01-01 00:00:00 | first_error | said \"hi\"" in texts["a"]
    assert "Time range: **2024-01-15 12:00:00 → 2024-01-15 12:30:00**." in texts["a"]
    assert "- No significant timeline events extracted." in texts["b"] and "Top error signatures: none." in texts["b"]


def test_json(found):
    documents = {r.log_id: json.loads(r.report_json) for r in report.json(report.document(found, CFG)).collect()}
    doc = documents["a"]
    assert list(doc) == [
        "ok", "metadata", "severity", "summary", "root_causes", "anomalies", "error_clusters", "timeline",
        "incident_report_markdown",
    ]
    assert doc["severity"] == "P1" or doc["severity"] == "P2"
    assert doc["timeline"][0]["timestamp"] == "0001-01-01T00:00:00"
    assert doc["anomalies"][0]["anomaly_type"] == "error_spike" and "pos" not in doc["anomalies"][0]
    assert doc["error_clusters"][0]["count"] == 6
    assert documents["b"]["timeline"] == [] and documents["b"]["root_causes"][0]["first_signal_at"] is None
    assert documents["b"]["severity"] == "P4"


def test_prompt_and_own_writer(found):
    row = report.prompts(found, CFG).filter("log_id = 'a'").first()
    assert "KEY ANOMALIES DETECTED:\nerror_spike (high) z=" in row.prompt and "services=['web']" in row.prompt
    import pyspark.sql.functions as F

    text = report.markdown(found, CFG, write=lambda prompt: F.concat(F.lit("own "), F.length(prompt))).first().report
    assert "own " in text


def test_inline_rows_and_continuations(entries):
    rows = [entry(i, response_time_ms=1.0, ts=i) for i in range(400)]
    rows += [entry(1000 + i, response_time_ms=900.0 + i, ts=5000 - i) for i in range(23)] + [entry(1, response_time_ms=999.0)]
    cfg = CFG.but(report_inline_rows=10)
    spikes = anomalies.latency_spikes(entries(rows), cfg)
    inline = report._first_anomalies(spikes, 10).orderBy("pos").collect()
    rest = report.continuations(spikes, cfg).orderBy("part").collect()
    order = [a.affected_lines[0] for a in inline] + [a.affected_lines[0] for r in rest for a in r.anomalies]
    assert order == [1] + [1022 - i for i in range(23)]
    assert [(r.part, len(r.anomalies)) for r in rest] == [(1, 10), (2, 4)]
