"""Comparing a query with its SQL in DuckDB, as the driver does: rows in any order, columns by name, values exactly."""

import glob
import os

import duckdb


def connect(directory):
    con = duckdb.connect()
    for p in glob.glob(f"{directory}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def text(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def compare(df, con, sql):
    rows, cols = df.collect(), sorted(df.columns)
    got = con.sql(sql)
    assert sorted(got.columns) == cols
    at = [got.columns.index(c) for c in cols]
    assert sorted("|".join(text(r[c]) for c in cols) for r in rows) == sorted("|".join(text(r[i]) for i in at) for r in got.fetchall())
