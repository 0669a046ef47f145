"""Compares a query with its SQL in DuckDB, by sorted columns and rows."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        df[name] = df[name].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else "" if v is None else repr(float(v)) if isinstance(v, (float, np.floating)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(found, expected):
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) == len(expected)
    a, b = canonical(found), canonical(expected)
    different = (a != b).any(axis=1)
    assert not different.any(), f"{a[different].head(3)}\n{b[different].head(3)}"
