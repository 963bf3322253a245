"""Compares a query with its SQL on the small tables."""

import functools
import glob
import numbers
import os

import duckdb
import pandas as pd


@functools.cache
def connection(folder):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def text(v):
        return None if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(text, r)) for r in pdf.itertuples(index=False, name=None)), key=str)


def check(spark, folder, f, sql):
    got, want = f(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
