"""Comparison of a query's rows with DuckDB's over the same tables."""

from __future__ import annotations

import decimal
import glob
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, list) else v


def duck(sf: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def assert_same(df, sql: str, sf: str) -> None:
    r = duck(sf).sql(sql)
    cols = sorted(df.columns)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = Counter(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
    got = Counter(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
