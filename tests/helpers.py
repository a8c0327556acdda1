"""Running queries beside their SQL."""

import glob
import numbers
import os

import duckdb
import pandas as pd


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, numbers.Integral) and abs(v) > 2**53:
        return str(int(v))
    return round(float(v), 9) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(frame):
    """Column names and rows, comparable whatever the order and the integer types."""
    names = sorted(frame.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)), key=str)
