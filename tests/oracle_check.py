"""Runs registered queries and their SQL side by side and compares them as sets of rows."""

from __future__ import annotations

import math
import pathlib

import duckdb

from faultline.plans.lanes import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if pathlib.Path(folder, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both agree, else a short account of the difference."""
    got = spark_df.collect()
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    have = rows_of(spark_df.columns, got)
    if have == want:
        return None
    missing = [w for w in want if w not in set(have)][:2]
    extra = [h for h in have if h not in set(want)][:2]
    return f"{len(have)} rows against {len(want)}; only here {extra}; only in SQL {missing}"
