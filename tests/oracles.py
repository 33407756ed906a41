"""Compares a query with its SQL in DuckDB on the same tables."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    v = float(v)
    return "nan" if math.isnan(v) else v + 0.0


def key(row):
    return tuple((v is None, str(type(v).__name__), round(v, 4) if isinstance(v, float) else str(v)) for v in row)


def differences(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-7))
    return [(g, w) for g, w in zip(got, want, strict=True) if not all(map(close, g, w))]
