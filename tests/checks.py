"""Rows of Spark and of DuckDB in one comparable form."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connection(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{folder}/{f}')")
    return con


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
