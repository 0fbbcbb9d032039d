import datetime as dt
import pathlib
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from faultline.schema import ANOMALIES, LOG_ENTRIES, LOG_LINES, ddl  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("faultline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def lines(spark):
    """Text of one or more logs to numbered lines."""

    def make(text: str, log_id: str = "a"):
        rows = [(log_id, i, line) for i, line in enumerate(text.splitlines(), 1)]
        return spark.createDataFrame(rows, ddl(LOG_LINES))

    return make


BASE = dt.datetime(2024, 1, 15, 12, 0, 0)


def entry(line, message="m", level="INFO", ts=None, log_id="a", **more):
    """One entry row; ``ts`` may be a number of seconds after ``BASE``."""
    if isinstance(ts, (int, float)):
        ts = BASE + dt.timedelta(seconds=ts)
    row = dict.fromkeys(LOG_ENTRIES) | {
        "log_id": log_id,
        "line_number": line,
        "raw_line": message,
        "ts": ts,
        "level": level,
        "source": "python",
        "message": message,
        "metadata": {},
    }
    return row | more


@pytest.fixture(scope="session")
def entries(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r[c] for c in LOG_ENTRIES) for r in rows], ddl(LOG_ENTRIES))

    return make


@pytest.fixture(scope="session")
def no_anomalies(spark):
    return spark.createDataFrame([], ddl(ANOMALIES))


def by_line(frame):
    return frame.orderBy(F.col("line_number")).collect()
