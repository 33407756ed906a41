"""Volatility: whole-sample, rolling, regimes and spike episodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import annual_volatility, dbl, present, volatility_regime
from tailframe.plans import settings as S

from .frames import BY, last_rows, ordered, so_far, whole


def last_n(df: DataFrame, n: int, by=BY, time: str = "d") -> DataFrame:
    """The last n rows of each series; Spark ranks before it shuffles (WindowGroupLimit)."""
    w = whole(by).orderBy(F.col(time).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def historical_volatility(returns: DataFrame, window: int | None = None, by=BY, time: str = "d") -> DataFrame:
    sample = last_n(returns, window, by, time) if window else returns
    out = sample.groupBy(*by).agg(F.stddev_samp("r").alias("daily"), F.count("*").alias("n_observations"))
    daily = F.when(present("daily") & (F.col("n_observations") > 1), F.col("daily"))
    return out.select(
        *by,
        daily.alias("daily"),
        (daily * dbl(math.sqrt(S.WEEK_DAYS))).alias("weekly"),
        (daily * dbl(math.sqrt(S.MONTH_DAYS))).alias("monthly"),
        annual_volatility(daily).alias("annualised"),
        (F.lit(window).cast("long") if window else F.col("n_observations")).alias("window"),
        "n_observations",
    )


def rolling_volatility(returns: DataFrame, window: int = S.ROLLING_WINDOW, annualise: bool = True, by=BY, time: str = "d") -> DataFrame:
    """Adds vol, NULL until the window is full."""
    w = last_rows(window, by, time)
    sigma = F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w))
    return returns.withColumn("vol", annual_volatility(sigma) if annualise else sigma)


def regimes(rolling: DataFrame, by=BY, time: str = "d") -> DataFrame:
    """Of each series: its last rolling volatility against its mean."""
    out = rolling.where(present("vol")).groupBy(*by).agg(F.max_by("vol", time).alias("current_vol"), F.avg("vol").alias("average_vol"))
    return out.withColumn("regime", volatility_regime("current_vol", "average_vol"))


def spike_episodes(rolling: DataFrame, multiple: float = S.SPIKE_MULTIPLE, by=BY, time: str = "d") -> DataFrame:
    """Runs of rows above `multiple` times the series' median: start_date, end_date, peak and duration
    in rows. An island is a value of (rows so far - spikes so far), which only changes between
    runs; the same schema whether there are episodes or not."""
    w = so_far(by, time)
    v = rolling.where(present("vol")).select(*by, time, "vol")
    v = v.withColumn("_limit", F.percentile("vol", F.lit(0.5)).over(whole(by)) * dbl(multiple))
    v = v.withColumn("_spike", (F.col("vol") > F.col("_limit")).cast("int"))
    v = v.withColumn("_island", F.row_number().over(ordered(by, time)) - F.sum("_spike").over(w))
    out = v.where("_spike = 1").groupBy(*by, "_island").agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.max("vol").alias("peak_volatility"), F.count("*").alias("duration_days"))
    return out.drop("_island")


def spike_threshold(rolling: DataFrame, multiple: float = S.SPIKE_MULTIPLE, by=BY) -> DataFrame:
    return rolling.where(present("vol")).groupBy(*by).agg((F.percentile("vol", F.lit(0.5)) * dbl(multiple)).alias("threshold"))
