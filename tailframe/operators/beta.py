"""Benchmark regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import beta_confidence, present
from tailframe.functions.distributions import t_two_sided

from .frames import BY, last_rows


def align(asset: DataFrame, benchmark: DataFrame, time: str = "d") -> DataFrame:
    """Asset returns with the benchmark's (column b) of the same day; days that either lacks go.
    The benchmark is one series: Spark broadcasts it if its size allows, else joins by day."""
    b = benchmark.where(present("r")).select(time, F.col("r").alias("b"))
    return asset.where(present("r")).join(b, time)


def regression(aligned: DataFrame, by=BY, p_values: bool = True) -> DataFrame:
    """Beta by two routes, from the moments and by Spark's least squares, and its statistics. The two
    are the same estimator, so routes_agree says whether they came out the same (to 1e-8). All are
    NULL for fewer than 2 rows or a benchmark that doesn't vary."""
    m = aligned.groupBy(*by).agg(
        F.count("*").alias("n_observations"),
        F.covar_samp("r", "b").alias("c"),
        F.var_samp("b").alias("vb"),
        F.var_samp("r").alias("vr"),
        F.avg("r").alias("mr"),
        F.avg("b").alias("mb"),
        F.regr_slope("r", "b").alias("ls"),
    )
    n = F.col("n_observations")
    usable = (n >= 2) & (F.col("vb") > 0)
    slope = F.when(usable, F.col("c") / F.nullif("vb", F.lit(0.0)))
    least_squares = F.when(usable, F.col("ls"))
    r2 = F.when(usable, F.when(F.col("vr") > 0, F.col("c") * F.col("c") / F.nullif(F.col("vb") * F.col("vr"), F.lit(0.0))).otherwise(F.lit(0.0)))
    rest = F.greatest(F.col("vr") - slope * F.col("c"), F.lit(0.0))
    se = F.when(usable & (n > 2), F.sqrt(rest / F.col("vb") / (n - 2)))
    out = m.select(
        *by,
        slope.alias("beta_moments"),
        least_squares.alias("beta_regression"),
        (F.abs(slope - least_squares) <= 1e-8 * F.greatest(F.abs(slope), F.lit(1.0))).alias("routes_agree"),
        (F.col("mr") - slope * F.col("mb")).alias("alpha"),
        r2.alias("r_squared"),
        (F.signum(F.col("c")) * F.sqrt(r2)).alias("correlation"),
        se.alias("standard_error"),
        F.when(se > 0, slope / F.nullif(se, F.lit(0.0))).alias("t_statistic"),
        "n_observations",
    ).withColumn("confidence", beta_confidence("n_observations", "r_squared"))
    if not p_values:
        return out
    out = out.withColumn("p_value", t_two_sided("t_statistic", (n - 2).cast("double")))
    return out.withColumn("is_significant", F.col("p_value") < 0.05)


def rolling_beta(aligned: DataFrame, window: int = 60, by=BY, time: str = "d") -> DataFrame:
    w = last_rows(window, by, time)
    beta = F.covar_samp("r", "b").over(w) / F.nullif(F.var_samp("b").over(w), F.lit(0.0))
    return aligned.withColumn("rolling_beta", F.when(F.count("*").over(w) == window, beta))


def fitted_line(aligned: DataFrame, points: int = 50, by=BY) -> DataFrame:
    """alpha + beta * x at equal steps over each series' range of benchmark returns."""
    span = aligned.groupBy(*by).agg(F.min("b").alias("_lo"), F.max("b").alias("_hi"))
    line = regression(aligned, by, p_values=False).select(*by, "alpha", "beta_regression").join(span, list(by))
    at = line.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = at.withColumn("x", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("k") / (points - 1))
    return at.select(*by, "k", "x", (F.col("alpha") + F.col("beta_regression") * F.col("x")).alias("y"))
