"""Rows of both engines in one comparable form."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _one(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return round(float(x), 6) if isinstance(x, (int, float, np.integer, np.floating)) else x


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(_one, r)) for r in df.values.tolist()), key=repr)
