"""Compares a query with its SQL: column names, row count and values, whatever the order of rows."""

from __future__ import annotations

import math
import os

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            at = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both results are the same."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want_rows = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in want_rows), key=repr)
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    only, other = sorted(a - b, key=repr), sorted(b - a, key=repr)
    return f"{len(mine)} rows and {len(theirs)}; only here {only[:3]}; only in SQL {other[:3]}"
