"""End-to-end views: the market measures of every series and their composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import annual_volatility, beta_confidence, dbl, known, loss, present, volatility_regime

from . import returns, scorecard
from .frames import last_rows, ordered, so_far


def market_measures(prices: DataFrame, benchmark: DataFrame | None = None, confidence: float = 0.99, by: str = "series_id", time: str = "d") -> DataFrame:
    """Volatility, VaR, drawdown, beta and regime of each series of cleaned prices that has returns. Whatever a
    series lacks stays NULL. The regime compares the last 60-day volatility with its mean.

    One scan, one shuffle by series and one aggregate: the returns, peaks and rolling volatilities are windows over
    the same rows, and the benchmark's returns are met by day."""
    rows = prices.withColumn("_p", known("adj_close")).select(by, time, "_p")
    ratio = F.col("_p") / F.nullif(F.lag("_p").over(ordered((by,), time)), F.lit(0.0))
    rows = rows.withColumns({"r": F.when(ratio > 0, F.ln(ratio)), "_peak": F.max("_p").over(so_far((by,), time))})
    # Days with returns are a partition of their own, so that no frame counts others.
    rows = rows.withColumn("_day", F.col("r").isNotNull())
    frame = last_rows(60, (by, "_day"), time)
    rows = rows.withColumn("_vol", F.when(F.col("_day") & (F.count("r").over(frame) == 60), annual_volatility(F.stddev_samp("r").over(frame))))
    if benchmark is not None:
        b = returns.log_returns(benchmark).select(time, F.col("r").alias("_b"))
        rows = rows.join(b, time, "left").withColumn("_b", F.when(F.col("_day"), F.col("_b")))
    else:
        rows = rows.withColumn("_b", F.lit(None).cast("double"))
    one = rows.groupBy(by).agg(
        F.count("r").alias("_n"),
        F.stddev_samp("r").alias("_sd"),
        F.percentile("r", dbl(1.0 - confidence)).alias("_q"),
        F.min((F.col("_p") - F.col("_peak")) / F.col("_peak")).alias("max_drawdown"),
        F.count("_b").alias("_pairs"),
        F.covar_samp("r", "_b").alias("_c"),
        F.var_samp("_b").alias("_vb"),
        F.var_samp(F.when(F.col("_b").isNotNull(), F.col("r"))).alias("_vr"),
        F.max_by("_vol", F.when(F.col("_vol").isNotNull(), F.col(time))).alias("_now"),
        F.avg("_vol").alias("_usual"),
    ).where("_n > 0")
    usable = (F.col("_pairs") >= 2) & (F.col("_vb") > 0)
    r2 = F.when(usable, F.when(F.col("_vr") > 0, F.col("_c") * F.col("_c") / F.nullif(F.col("_vb") * F.col("_vr"), F.lit(0.0))).otherwise(F.lit(0.0)))
    enough = F.col("_n") > 1
    return one.select(
        by,
        F.when(enough & present("_sd"), annual_volatility("_sd")).alias("volatility"),
        F.when(enough, loss("_q")).alias("var_99"),
        "max_drawdown",
        F.when(usable, F.col("_c") / F.nullif("_vb", F.lit(0.0))).alias("beta"),
        F.when(F.col("_pairs") > 0, beta_confidence("_pairs", r2)).alias("beta_confidence"),
        F.when(F.col("_usual").isNull(), "normal").otherwise(volatility_regime("_now", "_usual")).alias("regime"),
    )


def assess(prices: DataFrame, benchmark: DataFrame | None = None, ratios: DataFrame | None = None, valuations: DataFrame | None = None, confidence: float = 0.99, weights: dict[str, float] | None = None, by: str = "series_id") -> DataFrame:
    """The composite of each series. ratios and valuations have the column entity, which is
    matched with the series; both are optional, and so is each of their rows."""
    market = scorecard.score_market(market_measures(prices, benchmark, confidence, by)).withColumnRenamed(by, "entity")
    fundamentals = scorecard.fundamental(ratios) if ratios is not None else None
    return scorecard.compose(market, fundamentals, valuations, weights)
