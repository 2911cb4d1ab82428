"""Side-by-side check of a registered query against its DuckDB SQL: column
names, row count and the multiset of row values (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time
from collections import Counter

import duckdb

from ..sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    scols = sdf.columns
    res = {"name": name, "spark_s": round(t1 - t0, 2), "rows_spark": len(srows), "rows_sql": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    res["values_match"] = res["cols_match"] and _rows(scols, srows) == _rows(dcols, drows)
    if not res["cols_match"]:
        res["cols"] = (sorted(scols), sorted(dcols))
    elif not res["values_match"]:
        a, b = _rows(scols, srows), _rows(dcols, drows)
        res["only_spark"] = list((a - b).elements())[:3]
        res["only_sql"] = list((b - a).elements())[:3]
    return res
