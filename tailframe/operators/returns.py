"""Returns, cumulation and index levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import present

from .frames import BY, ordered, so_far


def compute_returns(prices: DataFrame, method: str = "log", price: str = "adj_close", by=BY, time: str = "d") -> DataFrame:
    """by, time, r: change from the row before in the same series. Rows without one, and those
    where either price is missing or (for log) not positive, are left out."""
    before = F.lag(price).over(ordered(by, time))
    ratio = F.col(price) / F.nullif(before, F.lit(0.0))
    if method == "log":
        r = F.when(ratio > 0, F.ln(ratio))
    elif method == "simple":
        r = ratio - 1
    else:
        raise ValueError(f"unknown return method: {method!r}")
    return prices.select(*by, time, r.alias("r")).where(present("r"))


def log_returns(prices: DataFrame, **how) -> DataFrame:
    return compute_returns(prices, "log", **how)


def simple_returns(prices: DataFrame, **how) -> DataFrame:
    return compute_returns(prices, "simple", **how)


def cumulative_return(returns: DataFrame, method: str = "log", by=BY) -> DataFrame:
    total = F.sum("r") if method == "log" else F.product(F.col("r") + 1) - 1
    return returns.where(present("r")).groupBy(*by).agg(total.alias("cumulative_return"), F.avg("r").alias("mean_return"), F.count("r").alias("n"))


def price_index(returns: DataFrame, method: str = "log", base: float = 100.0, by=BY, time: str = "d") -> DataFrame:
    """The level that the returns lead to, from `base` before the first."""
    w = so_far(by, time)
    level = F.exp(F.sum("r").over(w)) if method == "log" else F.product(F.col("r") + 1).over(w)
    return returns.where(present("r")).withColumn("level", F.lit(float(base)) * level)
