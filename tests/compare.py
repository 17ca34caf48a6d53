"""Differential check of a Spark query against its DuckDB oracle.

Mirrors the correctness gate: same row count, same column names, same
order-insensitive multiset of values.
"""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
USED = ["customer", "orders", "lineitem"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in USED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    vals = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if x is None else x for x in t))
    return names, vals


def compare(spark_df, con, sql):
    s_rows = [tuple(r) for r in spark_df.collect()]
    s_names, s_vals = canon(spark_df.columns, s_rows)
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    d_names, d_vals = canon(d_cols, d_rows)
    problems = []
    if s_names != d_names:
        problems.append(f"columns differ: spark={s_names} oracle={d_names}")
    if len(s_vals) != len(d_vals):
        problems.append(f"row count: spark={len(s_vals)} oracle={len(d_vals)}")
    elif s_vals != d_vals:
        diff = [(a, b) for a, b in zip(s_vals, d_vals) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_vals)
