"""Compares a frame with DuckDB's answer on the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p += "/*.parquet" if os.path.isdir(p) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    def one(v) -> str:
        if v is None or v is pd.NA or v != v:
            return ""
        return format(v, ".10g") if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)
