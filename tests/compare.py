"""Spark result against DuckDB result: columns by name, rows in any order."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(table, key=repr)


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    for group, members in {
        "int": ("bigint", "int", "integer", "smallint", "tinyint"),
        "double": ("double", "float"),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
        "date": ("date",),
    }.items():
        if dtype in members:
            return group
    return dtype


def difference(frame, con, sql: str) -> str | None:
    """None when both agree, else a short account of the first difference."""
    found = con.execute(sql)
    expected_names = [d[0] for d in found.description]
    expected_types = {d[0]: str(d[1]) for d in found.description}
    expected = found.fetchall()
    if sorted(frame.columns) != sorted(expected_names):
        return f"columns {sorted(frame.columns)} != {sorted(expected_names)}"
    mismatched = {
        c: (t, expected_types[c]) for c, t in frame.dtypes if kind(t) != kind(expected_types[c])
    }
    if mismatched:
        return f"types {mismatched}"
    got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    want = sorted_rows(expected_names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(expected_names)}\n  spark  {a}\n  duckdb {b}"
    return None if got else "EMPTY"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
