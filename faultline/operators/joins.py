"""The one place that decides whether a frame with one narrow row per log may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import BROADCAST_LOGS, Settings


def attach(rows: DataFrame, per_log: DataFrame, cfg: Settings, how: str = "inner") -> DataFrame:
    """Join a frame that holds at most one narrow row per log to many rows of those logs.

    With a known fleet below the bound the per-log side is broadcast. Otherwise the join stays unhinted. Spark then
    compares measured sizes at run time; it can split the partitions of hot logs if ``per_log`` is a written table, not
    an aggregate.
    """
    if cfg.fleet is not None and cfg.fleet <= BROADCAST_LOGS:
        per_log = F.broadcast(per_log)
    return rows.join(per_log, "log_id", how)
