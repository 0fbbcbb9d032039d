import pytest
from conftest import entry

from faultline import Settings
from faultline.operators import anomalies, ordered

CFG = Settings()


def minutes(errors_by_minute, plain=8):
    rows = []
    for minute, errors in enumerate(errors_by_minute):
        for j in range(errors or plain):
            rows.append(entry(len(rows) + 1, level="ERROR" if errors else "INFO", ts=minute * 60 + j * 0.1))
    return rows


def test_spike_at_a_low_threshold(entries):
    found = anomalies.all_anomalies(entries(minutes([0, 0, 40, 0, 0])), CFG.but(z_threshold=1.5)).collect()
    assert [(a.anomaly_type, a.severity) for a in found] == [("error_spike", "high")]
    assert found[0].affected_lines == list(range(17, 57))
    assert found[0].z_score == pytest.approx(2.0) and found[0].baseline_value == pytest.approx(0.2)
    assert found[0].description == "Error rate spike in 1m window: 100.0% (z=2.00)"


@pytest.mark.parametrize("windows, fires", [(7, False), (8, True)])
def test_spike_needs_eight_windows(entries, windows, fires):
    found = anomalies.error_spikes(entries(minutes([0] * (windows - 1) + [9])), CFG)
    assert (found.count() == 1) is fires


def test_spike_lines_are_the_first_two_hundred(entries):
    found = anomalies.error_spikes(entries(minutes([0] * 9 + [500])), CFG).collect()
    assert found[0].affected_lines == list(range(73, 273))


def test_calm_and_constant_series(entries):
    calm = entries([entry(i, ts=i) for i in range(40)])
    steady = entries([entry(i, level="ERROR", ts=60 * i, response_time_ms=5.0) for i in range(40)])
    assert anomalies.all_anomalies(calm, CFG).count() == 0
    assert anomalies.all_anomalies(steady, CFG).count() == 0


def test_silence(entries):
    rows = [entry(i, ts=i) for i in range(20)] + [entry(20, ts=3600)]
    found = anomalies.silence(entries(rows), CFG).collect()
    assert len(found) == 1 and found[0].affected_lines == [19, 20]
    assert found[0].observed_value == 3581.0
    assert found[0].severity == "medium"


def test_silence_over_chunk_edges_and_ties(entries):
    # three entries share each time; neighbours are the last of one time and the first of the next
    rows = [entry(3 * i + j, ts=700 * i if i < 40 else 700 * 39 + 40_000) for i in range(41) for j in range(3)]
    for chunk in ("1 minute", "1 hour", "1 day"):
        found = anomalies.silence(entries(rows), CFG.but(time_chunk=chunk)).collect()
        assert [a.affected_lines for a in found] == [[119, 120]]
        assert found[0].severity == "high"


@pytest.mark.parametrize("values, count", [([10.0] * 9 + [500.0], 1), ([10.0] * 8 + [500.0], 0)])
def test_latency(entries, values, count):
    rows = [entry(i, response_time_ms=v) for i, v in enumerate(values)] + [entry(99, response_time_ms=0.0)]
    found = anomalies.latency_spikes(entries(rows), CFG).collect()
    assert len(found) == count
    if count:
        assert found[0].ts is None and found[0].affected_lines == [9] and found[0].z_score == pytest.approx(3.0)


@pytest.mark.parametrize("windows, runs", [(21, 0), (22, 1)])
def test_cascade_needs_twenty_two_windows(entries, windows, runs):
    found = anomalies.cascades(entries(minutes([0] * (windows - 3) + [4, 4, 4])), CFG).collect()
    assert len(found) == runs
    if runs:
        assert found[0].description == "Sustained elevated errors for 3 consecutive minute windows"
        assert len(found[0].affected_lines) == 12 and found[0].observed_value == 1.0


def test_cascade_runs_count_observed_windows(entries):
    # an unobserved minute between flagged ones does not break a run, an observed calm one does
    gap = minutes([0] * 40 + [9, 9])
    gap += [entry(1000 + j, level="ERROR", ts=60 * 45 + j) for j in range(9)]
    assert anomalies.cascades(entries(gap), CFG).count() == 1
    assert anomalies.cascades(entries(minutes([0] * 40 + [9, 9, 0, 9])), CFG).count() == 0


def test_cascade_line_caps(entries):
    found = anomalies.cascades(entries(minutes([0] * 80 + [70] * 8)), CFG).collect()
    lines = found[0].affected_lines
    assert len(lines) == 300 and lines[49:51] == [690, 711]


def test_order(entries):
    rows = minutes([0] * 80 + [4, 4, 4]) + [entry(9000, ts=999_999, response_time_ms=None)]
    rows += [entry(9100 + i, response_time_ms=500.0 if i == 3 else 1.0) for i in range(20)]
    found = anomalies.all_anomalies(entries(rows), CFG)
    kinds = [a.anomaly_type for a in ordered.top(found, ["log_id"], anomalies.order_keys(), 99).collect()]
    every = sorted((a.severity for a in found.collect()), key=["critical", "high", "medium"].index)
    assert sorted(kinds) == sorted(a.anomaly_type for a in found.collect())
    assert every[0] == "critical"


def test_logs_do_not_mix(entries):
    one = [entry(i, ts=i, log_id="x") for i in range(20)] + [entry(20, ts=3600, log_id="x")]
    other = [entry(i, ts=90 * i, log_id="y") for i in range(50)]
    found = anomalies.all_anomalies(entries(one + other), CFG).collect()
    assert {a.log_id for a in found} == {"x"}


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_positions(spark, bucket):
    rows = [(k, n * 3, n) for k in "ab" for n in range(1, 40) if (n + ord(k)) % 4]
    frame = spark.createDataFrame(rows, "k string, n long, v long").selectExpr("*", f"floor(n / {bucket}) AS b")
    placed = ordered.positions(frame, ["k"], "b", ["n"])
    found = {(r.k, r.n): r.pos for r in placed.collect()}
    for k in "ab":
        mine = sorted(r for r in rows if r[0] == k)
        assert [found[(k, r[1])] for r in mine] == list(range(1, len(mine) + 1))
