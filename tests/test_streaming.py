import datetime as dt
import pathlib
import random
import time
import urllib.parse

import numpy as np
import oracle_check
import pytest
from conftest import BASE, entry
from pyspark.sql import functions as F

from faultline import Settings
from faultline.operators.parse import dispatch
from faultline.plans import driver_queries
from faultline.plans.oracles import ORACLES
from faultline.schema import LOG_ENTRIES, ddl
from faultline.streaming import lines as stream_lines
from faultline.streaming import rates, stateful

CFG = Settings()


@pytest.fixture
def stream(spark, entries, tmp_path):
    """Writes each batch as one file and gives the stream over them, file by file in order."""

    def make(*batches):
        folder = tmp_path / "in"
        for rows in batches:
            entries(rows).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(ddl(LOG_ENTRIES)).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return make


def run(spark, frame, tmp_path, name):
    out = str(tmp_path / name)
    query = (
        frame.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return spark.read.schema(frame.schema).parquet(out)


def test_parse_a_declared_format(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("app | 2024-01-15 12:00:00 ERROR boom\n\nfree\n")
    frame = stream_lines.parse(stream_lines.read(spark, str(tmp_path / "logs")), "docker", CFG)
    rows = run(spark, frame, tmp_path, "parsed").orderBy("message").collect()
    assert [(r.level, r.message, r.service) for r in rows] == [("ERROR", "boom", "app"), ("INFO", "free", None)]


def test_error_rates_leave_out_late_entries(spark, stream, tmp_path):
    first = [entry(i, level="ERROR" if i % 2 else "INFO", ts=i) for i in range(10)] + [entry(50, ts=600)]
    late = [entry(60, level="ERROR", ts=5), entry(61, ts=1200)]
    found = run(spark, rates.error_rates(stream(first, [entry(55, ts=610)], late, [entry(70, ts=9000)]), CFG, "1 minute"), tmp_path, "rates")
    got = {r.window_start: (r.total, r.errors) for r in found.collect()}
    assert got[BASE] == (10, 5) and got[BASE + dt.timedelta(minutes=10)] == (2, 0)


def test_silence_alarms(spark, stream, tmp_path):
    rows = [entry(i, ts=i) for i in range(20)] + [entry(30 + i, ts=3600 + i) for i in range(3)]
    frame = rates.silence_alarms(stream(rows, [entry(90, ts=9000)], [entry(91, ts=9999)]), 300, "1 minute")
    found = run(spark, frame, tmp_path, "silence").orderBy("active_from").collect()
    assert [(r.silent_since, r.entries) for r in found][:2] == [
        (BASE + dt.timedelta(seconds=19), 20),
        (BASE + dt.timedelta(seconds=3602), 3),
    ]


def rows_in_memory(spark, frame, seconds=90):
    """The first rows a stream gives, however long after its input they come."""
    name = f"rows_{time.time_ns()}"
    query, until = frame.writeStream.format("memory").queryName(name).start(), time.time() + seconds
    try:
        while time.time() < until and not spark.table(name).count():
            time.sleep(0.5)
        return spark.table(name).collect()
    finally:
        query.stop()


def test_silence_alarms_without_further_input(spark, stream, tmp_path):
    rows = [entry(i, ts=i) for i in range(12)] + [entry(40, ts=400, log_id="few")]
    frame = stateful.silence_gaps(stream(rows), floor_seconds=2.0)
    found = rows_in_memory(spark, frame)
    assert [(r.log_id, r.silent_since, r.until, r.kind, r.mean) for r in found] == [("a", BASE + dt.timedelta(seconds=11), None, "ongoing", 1.0)]


def test_silence_gaps_by_moments_across_batches(spark, stream, tmp_path):
    rng = random.Random(3)
    at, times = 0.0, []
    for i in range(300):
        at += 2_000 if i in (100, 200) else rng.uniform(5, 80)
        times.append(round(at, 3))
    batches = [[entry(i, ts=t) for i, t in enumerate(times[a : a + 50])] for a in range(0, 300, 50)]
    for batch in batches:
        rng.shuffle(batch)
    found = run(spark, stateful.silence_gaps(stream(*batches), timers=False), tmp_path, "gaps").orderBy("until").collect()
    gaps, want = np.diff(times), []
    for i in range(3, len(gaps)):
        mu, sigma = gaps[:i].mean(), gaps[:i].std()
        if gaps[i] > max(60, mu + 3 * sigma):
            want.append((round(gaps[i], 3), round(mu, 6), round(sigma, 6)))
    assert [(round(r.gap, 3), round(r.mean, 6), round(r.spread, 6)) for r in found] == want and len(want) >= 2


def lines_stream(spark, tmp_path, batches):
    for rows in batches:
        frame = spark.createDataFrame(rows, "log_id string, line_number long, raw_line string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))


@pytest.mark.parametrize("seed", range(2))
def test_streamed_tracebacks_equal_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    kinds = ["Traceback (most recent call last):", "  Traceback (most recent call last):", '  File "x"', "", "Err: bad", "KeyError", "2024-01-15 12:00:00,000 INFO m k", " \t", "a.b: c"]
    rows = [("a" if i % 3 else "b", i, rng.choice(kinds)) for i in range(1, 400)] + [("a", 500, "last"), ("b", 501, "last")]
    cuts = [0, *sorted(rng.sample(range(1, 400), 4)), len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    found = run(spark, stateful.python_entries(lines_stream(spark, tmp_path, batches), CFG, timers=False), tmp_path, "merged")
    whole = spark.createDataFrame(rows, "log_id string, line_number long, raw_line string")
    want = dispatch.entries(dispatch.parse_as(whole, "python", CFG))
    plain = lambda frame: sorted((r.log_id, r.line_number, r.raw_line, r.level, r.message, r.stack_trace or "", str(r.ts)) for r in frame.collect())
    assert plain(found) == plain(want) and any(r.stack_trace for r in want.collect())


def test_an_open_traceback_is_closed_by_time(spark, tmp_path):
    rows = [("a", 1, "Traceback (most recent call last):"), ("a", 2, '  File "x"')]
    frame = stateful.merge_tracebacks(lines_stream(spark, tmp_path, [rows]), wait_seconds=2)
    found = rows_in_memory(spark, frame)
    assert [(r.line_number, r.block) for r in found] == [(1, 'Traceback (most recent call last):\n  File "x"')]


def test_spike_baseline_from_moments_and_one_day_of_windows(spark):
    rng = random.Random(5)
    rows = [(log, BASE + dt.timedelta(hours=h), rng.random()) for log in "ab" for h in range(-120, 0)]
    earlier = spark.createDataFrame(rows, "log_id string, window_start timestamp_ntz, rate double")
    own = spark.createDataFrame([("a", BASE, 0.5), ("b", BASE + dt.timedelta(hours=3), 0.5)], earlier.schema)
    found = {r.log_id: r for r in rates.baseline(rates.daily_moments(earlier), earlier, own, "3 days").collect()}
    for log, hours in (("a", 0), ("b", 3)):
        since = BASE + dt.timedelta(hours=hours) - dt.timedelta(days=3)
        past = [r for name, ts, r in rows if name == log and ts >= since]
        assert found[log].windows == len(past)
        assert (found[log]["mean"], found[log].spread) == (pytest.approx(np.mean(past)), pytest.approx(np.std(past)))


def test_first_seen_errors(spark, stream, tmp_path):
    rows = [entry(i, f"worker {i} failed", "ERROR", ts=i) for i in range(9)] + [entry(20, "other", "ERROR", ts=3)]
    frame = stream_lines.first_seen_errors(stream(rows, [entry(30, "worker 77 failed", "ERROR", ts=11)]), "10 minutes")
    found = run(spark, frame.select("log_id", "template"), tmp_path, "first").collect()
    assert sorted(r.template for r in found) == ["other", "worker <NUM> failed"]


def test_spike_flags_can_run_a_batch_twice(spark, tmp_path):
    flags = rates.SpikeFlags(spark, str(tmp_path / "spikes"), CFG)

    def batch(minute, rate):
        rows = [("a", BASE + dt.timedelta(minutes=minute + i), 10, int(10 * r), r) for i, r in enumerate(rate)]
        return spark.createDataFrame(rows, "log_id string, window_start timestamp_ntz, total long, errors long, rate double")

    flags(batch(0, [0.1, 0.2, 0.1, 0.2, 0.1]), 0)
    for _ in range(2):
        flags(batch(5, [0.1, 0.9]), 1)
    found = spark.read.parquet(flags.flags).filter("batch = 1").collect()
    assert [(r.rate, round(r.mean, 2), r.windows) for r in found] == [(0.9, 0.14, 5)]
    assert spark.read.parquet(flags.windows).filter(F.col("batch") == 1).count() == 2


def test_tracebacks_arrive_in_bounded_parts(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    most = spark.read.parquet(f"{folder}/events.parquet").count() * 4
    monkeypatch.setattr(driver_queries, "ARRIVAL", most // 5 + 1)
    found = driver_queries.stream_tracebacks(spark, folder)
    place = pathlib.Path(urllib.parse.urlparse(found.inputFiles()[0]).path).parents[1]
    assert len([f for f in (place / "state" / "commits").iterdir() if f.name.isdigit()]) == 5
    assert oracle_check.compare(found, oracle_check.connect(folder), ORACLES["stream_tracebacks"]) is None
