"""Compares a DataFrame with SQL that DuckDB runs on the same Parquet files, without regard to order."""

import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
