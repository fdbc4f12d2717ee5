"""Compares queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def _cell(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v or str(v) in ("NaT", "<NA>"):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def normal(frame) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def assert_same(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
