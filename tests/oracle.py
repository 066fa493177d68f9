"""Spark-vs-DuckDB comparison used by the tests (and handy from the shell).

Columns are compared by name; float values are rounded to 6 decimals; rows
are compared as sorted multisets (order-insensitive)."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from tablab.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    try:
        if pd.isna(v):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 6)
        if r == int(r) and abs(r) < 1e15:
            return str(int(r))
        return repr(r)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: spark={sorted(s.columns)} duck={sorted(d.columns)}"
    if len(s) != len(d):
        return False, f"row count spark={len(s)} duck={len(d)}"
    cs, cd = canon(s), canon(d)
    if cs != cd:
        bad = [(a, b) for a, b in zip(cs, cd) if a != b][:3]
        return False, f"values differ (first: {bad}) cols={sorted(s.columns)}"
    return True, f"{len(s)} rows"
