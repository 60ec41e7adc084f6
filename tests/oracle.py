"""Comparison of a query with its SQL in DuckDB, whatever the order of rows."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "%.6g" % float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if not isinstance(v, datetime.datetime) else v.isoformat()


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def assert_same(df, sql, sf):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    found = connect(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
