"""Seeded series of the test recipes, as tables."""

import datetime as dt

import numpy as np
import pandas as pd

START = dt.date(2020, 1, 1)


def business_days(n, start="2020-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def table(spark, named, column="r", start="2020-01-01"):
    """named: series -> values. Columns series_id, d and `column`; None and NaN are NULL."""
    rows = []
    for name, values in named.items():
        rows += [(name, d, None if v is None or v != v else float(v)) for d, v in zip(business_days(len(values), start), values, strict=True)]
    return spark.createDataFrame(rows, f"series_id string, d date, {column} double").repartition(3)


def prices(spark, named, start="2020-01-01"):
    t = table(spark, named, "close", start)
    return t.selectExpr("series_id", "d", "close", "close AS adj_close", "1L AS volume", "CAST(unix_date(d) AS BIGINT) AS ingest_seq")


def normal_returns(n=2000, seed=7, mean=0.0004, sd=0.011):
    return np.random.default_rng(seed).normal(mean, sd, n)


def fat_returns(n=2000, seed=7):
    return np.random.default_rng(seed).standard_t(3, n) / np.sqrt(3) * 0.011


def garch_returns(n=2000, seed=11, omega=0.02, alpha=0.10, beta=0.87):
    rng = np.random.default_rng(seed)
    out, v = [], omega / (1 - alpha - beta)
    for z in rng.standard_normal(n):
        e = np.sqrt(v) * z
        out.append(e / 100)
        v = omega + alpha * e * e + beta * v
    return np.array(out)


def one(df, **where):
    for k, v in where.items():
        df = df.where(df[k] == v)
    (row,) = df.collect()
    return row


def ordered(df, column, by="d"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r[by])]
