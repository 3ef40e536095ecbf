"""Comparison of a query with its SQL on another engine."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "None"
        v = v.item() if hasattr(v, "item") else v
        return repr(int(v)) if isinstance(v, float) and v.is_integer() else repr(v)  # integers beside nulls are floats in pandas

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con.execute(sql).df()
