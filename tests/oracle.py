"""Runs a query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: None if v is None or pd.isna(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def agrees(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
