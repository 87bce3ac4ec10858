"""Compares a query with its SQL, run by DuckDB on the same tables."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(p + '/*.parquet') if os.path.isdir(p) else p!r})")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in rows)


def assert_same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = connection(sf_dir).execute(sql)
    expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    for a, b in zip(got[1], expected[1]):
        assert a == b
