"""Every registered query against its SQL on the smallest tables, and plan checks."""

import subprocess
import sys

import __spark_entry__ as driver
import oracle_check
import pytest
from conftest import ROOT

from faultline.plans.driver_queries import QUERIES
from faultline.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
WITHOUT_SQL = {"default_embedding_clusters", "report_markdown", "report_json", "report_prompt"}


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, con, name):
    assert oracle_check.compare(driver.queries()[name](spark, FOLDER), con, driver.oracle_sql()[name]) is None


def test_queries_without_sql_are_the_known_ones(spark):
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


def test_import_needs_no_session():
    code = "import __spark_entry__ as d; assert len(d.queries()) > 60; d.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_no_collecting_in_the_package():
    for path in (ROOT / "faultline").rglob("*.py"):
        # llm collects bounded training samples; the pipeline the names of the formats that occur
        if "llm" in path.parts or path.name == "pipeline.py":
            continue
        text = path.read_text()
        assert ".collect()" not in text and "toPandas" not in text, path
        assert ".rdd" not in text or path.name == "lanes.py", path


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = _plan(driver.queries()["error_rate_by_window"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "PushedFilters: [IsNotNull(ts)]" in plan


def test_first_n_lists_are_pruned_before_the_shuffle(spark):
    for name in ("top_error_messages", "first_errors", "error_spikes"):
        plan = _plan(driver.queries()[name](spark, FOLDER))
        assert name == "first_errors" or "WindowGroupLimit" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_python_in_parsing_and_detectors(spark):
    for name in ("parse_nginx_access", "parse_custom", "traceback_merge", "all_anomalies", "root_cause_ranking"):
        plan = _plan(driver.queries()[name](spark, FOLDER))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsIn", "MapIn"):
            assert node not in plan, name
