"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def assert_same(df, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(plain(row[names.index(c)]) for c in sorted(names)) for row in cursor.fetchall())
    have = Counter(tuple(plain(row[c]) for c in sorted(names)) for row in df.collect())
    assert have == want, f"only here: {list((have - want).items())[:3]}; only there: {list((want - have).items())[:3]}"
    return sum(have.values())
