"""Run a registered query on Spark and its SQL on DuckDB, compare rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(root: str):
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(canon(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    cols, rows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    got = rows_of(cols, rows)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} of {len(got[1])} rows differ, e.g. {diff[0][0]} vs {diff[0][1]}"
    types = {k: (type(a).__name__, type(b).__name__) for r, s in zip(got[1][:50], want[1][:50]) for k, a, b in zip(got[0], r, s) if type(a) is not type(b)}
    return f"types {types}" if types else None
