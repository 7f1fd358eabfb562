"""Spark results against DuckDB's, rows in any order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if "datetime" in str(out[c].dtype):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif out[c].dtype == object or str(out[c].dtype).startswith("str"):
            out[c] = out[c].map(lambda v: "~" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        else:
            out[c] = out[c].astype(float).round(6).fillna(-999)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)
