"""A query's rows held against its SQL in DuckDB, order aside."""

import os

import duckdb
import numpy as np
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (float, np.floating)):
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    return str(v).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((v is None, v or "") for v in r))


def same(spark, run, sql: str, sf_dir: str = SF) -> None:
    got, want = run(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
