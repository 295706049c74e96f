"""Compares a query with its DuckDB SQL, order aside."""

import os

import duckdb
import numpy as np
import pandas as pd


def rows(frame: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float | np.floating) and np.isnan(v):
            return None
        if isinstance(v, bool | np.bool_):
            return bool(v)
        if isinstance(v, int | np.integer):
            return int(v)
        if isinstance(v, float | np.floating):
            return float(f"{float(v):.10g}")
        return str(v)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def check(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
