"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def duck(folder: str):
    c = duckdb.connect()
    for p in glob.glob(os.path.join(folder, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c
