"""Comparison of a query's rows with DuckDB's on the same tables."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(directory: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def rows_of(columns, order, rows):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    assert rows_of(df.columns, order, df.collect()) == rows_of(names, order, cur.fetchall())
