"""Holds a query against its DuckDB SQL."""

import datetime
import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float) and x == int(x):
        return int(x)
    return x.date() if isinstance(x, datetime.datetime) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(value, r))) for r in df.itertuples(index=False, name=None))


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def agrees(spark, f, sql, folder=DATA):
    got, want = f(spark, folder).toPandas(), database(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
