"""Comparison of a Spark result with DuckDB's over the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        inside = "/*.parquet" if os.path.isdir(p) else ""
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{inside}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return repr(round(float(v), 7))
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].itertuples(index=False))


def assert_same(spark_frame, sql, connection):
    assert rows(spark_frame.toPandas()) == rows(connection.execute(sql).df())
