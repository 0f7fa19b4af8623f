"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return str(round(v, 6))
    return str(v)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(con, spark, query, sql) -> None:
    df = query(spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
