"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def cell(v):
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, int | float) and not isinstance(v, bool):
        return None if math.isnan(v) else round(float(v), 6)
    return None if v is None or str(v) in ("<NA>", "NaT") else v


def rows(frame, columns):
    return sorted(repr(tuple(cell(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(spark_frame, con, sql: str) -> None:
    got, want = spark_frame.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
