"""Comparison of a query with its SQL twin, as the driver does it."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("WEBLOOM_TESTDATA", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(_cell, r)) for r in frame.astype(object).itertuples(index=False))
