"""All tunables in one immutable object that callers pass in; nothing is read from globals or the environment."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# A frame with one narrow row per log may be broadcast only while the number of logs is known to stay below this.
BROADCAST_LOGS = 20_000


@dataclass(frozen=True)
class Settings:
    # detectors
    z_threshold: float = 2.5
    window: str = "1 minute"
    spike_line_cap: int = 200
    cascade_window_line_cap: int = 50
    cascade_line_cap: int = 300

    # clustering
    # None keeps all clusters
    max_clusters: int | None = 8
    min_cluster_size: int = 2
    # templates of a log that are compared; None compares all
    encode_cap: int | None = 200
    eps: float = 0.3
    vector_dims: int = 256

    # timeline; no cap keeps every event
    timeline_cap: int | None = 100
    timeline_line_cap: int = 50

    # ingest guards, off unless asked for: a guard drops whole logs to quarantine
    max_bytes: int | None = None
    max_line_breaks: int | None = None
    # files above this size are read in splits and numbered by block offsets instead of as one string
    whole_file_bytes: int = 64 * 1024 * 1024

    # detection; None looks at every line
    sample_lines: int | None = 20
    accept_score: float = 0.3

    # clock-dependent parsing; None means the clock at execution
    reference_time: dt.datetime | None = None
    default_year: int | None = None
    # zone of web-server error logs, whose times carry none; None keeps them as they are
    error_log_tz: str | None = None

    # evaluation and listings; None takes all rows
    eval_rows: int | None = 15
    listing_rows: int | None = 50

    # rows of a child table that go inline into one report document; the rest goes into continuations. None takes all
    report_inline_rows: int | None = 10_000

    # size of the pieces in which one log is put in order, so that no task ever sorts a whole log
    chunk_lines: int = 50_000
    time_chunk: str = "10 minutes"

    # number of logs, when the caller has counted them; enables broadcasting of one-row-per-log frames
    fleet: int | None = None

    report_title: str = "Incident Report"
    version: str = "v1.0"

    def __post_init__(self) -> None:
        limits = (self.encode_cap, self.timeline_cap, self.max_clusters, self.chunk_lines, self.sample_lines, self.eval_rows, self.listing_rows, self.report_inline_rows)
        if any(limit is not None and limit < 1 for limit in limits):
            raise ValueError("caps and chunk sizes must be positive")

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)

    def now(self) -> Column:
        if self.reference_time is None:
            return F.current_timestamp().cast("timestamp_ntz")
        return F.lit(self.reference_time.isoformat(sep=" ")).cast("timestamp_ntz")

    def year(self) -> Column:
        if self.default_year is None:
            return F.year(F.current_date()).cast("string")
        return F.lit(f"{self.default_year:04d}")
