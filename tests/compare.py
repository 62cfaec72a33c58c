"""Spark results against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def oracle(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {p.stem} as select * from read_parquet('{p}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, sql: str, sf: str):
    names, values = oracle(sql, sf)
    assert sorted(names) == sorted(df.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, values)
    only = (sorted(set(mine) - set(theirs), key=repr)[:3], sorted(set(theirs) - set(mine), key=repr)[:3])
    assert len(mine) == len(theirs), (len(mine), len(theirs), only)
    assert mine == theirs, only
    return len(mine)
