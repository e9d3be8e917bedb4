"""A query against its SQL in DuckDB."""

import os

import duckdb
import numpy as np


def connect(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{folder}/{t}')")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: "null" if x is None or (isinstance(x, float) and np.isnan(x)) else repr(round(float(x), 9)) if isinstance(x, (float, np.floating)) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, con, query, sql, folder):
    ours, theirs = plain(query(spark, folder).toPandas()), plain(con.execute(sql).fetchdf())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs), ours.merge(theirs, how="outer", indicator=True).query("_merge != 'both'").head()
