"""Comparison of a registered query with its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def same(spark, sf: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    names = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want
