"""Frequent messages in two passes against the single aggregate."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import frequent, summary
from faultline.plans.staging import Staging

SCHEMA = "log_id string, line_number long, level string, message string"


def both(spark, rows, count=5, buckets=frequent.BUCKETS):
    entries = spark.createDataFrame(rows, SCHEMA)
    columns = ["log_id", "message", "count", "first_line"]
    found = frequent.top_errors(entries, Staging(spark).table, count, buckets).select(columns).collect()
    want = summary.top_errors(entries, count).select(columns).collect()
    return sorted(map(str, found)), sorted(map(str, want))


def fleet():
    """A log of rare messages with a few frequent ones, one of ties only, one with two messages, one without errors."""
    rows = [("big", i, "ERROR", f"rare {i}") for i in range(3_000)]
    rows += [("big", 10_000 + i, "CRITICAL", f"often {i % 6}") for i in range(603)]
    rows += [("ties", i, "ERROR", f"same {i % 40}") for i in range(400)]
    rows += [("few", i, "ERROR", "one" if i % 3 else None) for i in range(9)]
    return [*rows, ("calm", 1, "INFO", "fine")]


@pytest.mark.parametrize("buckets", [1, 3, 64, frequent.BUCKETS])
def test_two_passes_give_the_rows_of_one(spark, buckets):
    for count in (1, 5, 7):
        found, want = both(spark, fleet(), count, buckets)
        assert found == want and len(want) > 2


def test_too_many_buckets_to_broadcast_are_counted_at_once(spark, monkeypatch):
    for most in (1, 45):
        monkeypatch.setattr(frequent, "MOST_KEYS", most)
        found, want = both(spark, fleet())
        assert found == want


def test_no_entries(spark):
    assert both(spark, []) == ([], [])


def test_rare_messages_are_not_shuffled(spark):
    entries = spark.createDataFrame([r for r in fleet() if r[0] == "big"], SCHEMA)
    staging, seen = Staging(spark), {}

    def stage(name, frame):
        seen[name] = staging.table(name, frame)
        return seen[name]

    found = frequent.top_errors(entries, stage)
    assert found.count() == 5
    assert seen["message_sums"].columns == ["log_id", "bucket", "n"]  # no message in the first shuffle
    errors = entries.select("*", frequent.bucket(frequent.BUCKETS))
    met = frequent.within(errors, seen["needed_buckets"])
    assert met.select("message").distinct().count() < 20 and met.where(F.col("message").startswith("often")).count() == 603
    plan = found._jdf.queryExecution().executedPlan().toString()
    first_exchange = plan.rindex("Exchange hashpartitioning(log_id")
    assert plan.index("BroadcastHashJoin") > plan.index("HashAggregate") and first_exchange < plan.index("BroadcastHashJoin")
