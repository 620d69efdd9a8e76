"""Compares a query with its SQL in DuckDB: same columns, same multiset of rows, floats to six places."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = con.sql(sql)
    assert columns == sorted(rel.columns)
    theirs = sorted(repr(tuple(plain(v) for v in r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs
