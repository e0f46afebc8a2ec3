"""Runs queries beside their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, run, sql: str, sf_dir: str) -> list[str]:
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    result = con.sql(sql)
    names = list(result.columns)
    if sorted(names) != columns:
        return [f"columns {sorted(names)} and {columns}"]
    at = [names.index(c) for c in columns]
    want = sorted(tuple(value(r[i]) for i in at) for r in result.fetchall())
    if got == want:
        return []
    left, right = set(got), set(want)
    return [f"{len(got)} and {len(want)} rows"] + [str(x) for x in got if x not in right][:2] + [str(x) for x in want if x not in left][:2]
