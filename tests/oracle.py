"""Compare a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}'")
    return con


def assert_same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=str)
    got = sorted([tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()], key=str)
    assert got == want
