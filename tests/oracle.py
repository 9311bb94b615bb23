"""Comparing a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.name.split('.')[0]} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))
