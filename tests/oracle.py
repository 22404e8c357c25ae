"""Runs a query's SQL in DuckDB and compares rows without order."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{x + 0.0:.6g}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(df, con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())
