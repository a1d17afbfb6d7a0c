"""Compare a query with its SQL twin on DuckDB, order-insensitively."""

from __future__ import annotations

import math

import duckdb

from filecensus.bridge import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(frame):
    return sorted(frame.columns), _rows(frame.columns, [tuple(r) for r in frame.collect()])


def duckdb_rows(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    return sorted(names), _rows(names, con.fetchall())
