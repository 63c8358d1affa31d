"""Spark rows against DuckDB rows: same columns, same multiset of values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def differences(df, sql: str, con) -> str:
    """Empty if both give the same rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: spark {sorted(df.columns)}, sql {sorted(names)}"
    order = sorted(names)
    theirs = sorted((repr(tuple(plain(r[names.index(c)]) for c in order)) for r in cur.fetchall()))
    ours = sorted((repr(tuple(plain(r[c]) for c in order)) for r in df.collect()))
    if ours == theirs:
        return ""
    a, b = set(ours), set(theirs)
    return f"spark {len(ours)} rows, sql {len(theirs)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
