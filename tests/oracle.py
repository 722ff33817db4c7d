"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder: str = FOLDER):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else f"{type(v).__name__[:3]}:{v}"


def rows_of(df, columns):
    return sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


def compare(con, df, sql):
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows_of(df, columns) == sorted(tuple(plain(r[i]) for i in place) for r in cur.fetchall())
