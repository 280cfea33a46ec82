"""Compares a query's rows with its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    """Sorted columns and sorted rows, numbers and missing values written alike."""

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return str(pd.Timestamp(v)) if hasattr(v, "year") else v.item() if hasattr(v, "item") else v

    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))


def assert_same(spark, query, sql, sf_dir):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(connection(sf_dir).sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
