"""Value at risk and expected shortfall from observed and fitted distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import col, dbl, loss, messages, normal_density, normal_quantile, over_days, present
from tailframe.functions.distributions import t_density, t_quantile
from tailframe.plans import settings as S

from .frames import BY, whole
from .sliding import rolling_quantile


def check(confidence: float, days: int = 1) -> None:
    if not 0.5 < confidence < 1.0:
        raise ValueError(f"confidence has to be between 0.5 and 1, not {confidence}")
    if days < 1:
        raise ValueError(f"the horizon has to be a day or more, not {days}")


def _value(c, portfolio_value: float | None):
    return c * dbl(portfolio_value) if portfolio_value is not None else F.lit(None).cast("double")


def historical_var(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, by=BY) -> DataFrame:
    """VaR as the linearly interpolated empirical quantile of log returns.

    tail_observations counts rows at or below the quantile, so ties raise it. Series with
    fewer than two returns give NULLs and a reason in warnings. The quantile is exact: counts of
    distinct values are merged by series, which adaptive execution can't split further.
    """
    check(confidence, days)
    r = returns.where(present("r"))
    level = 1.0 - confidence
    q = r.groupBy(*by).agg(F.percentile("r", dbl(level)).alias("daily_quantile"), F.count("*").alias("n_observations"), F.min("r").alias("_worst"))
    # One more aggregate instead of a window over all rows: the quantiles are a row a series.
    tail = r.join(q.select(*by, "daily_quantile"), list(by)).groupBy(*by).agg(F.count_if(F.col("r") <= F.col("daily_quantile")).alias("tail_observations"))
    out = q.join(tail, list(by))
    enough = F.col("n_observations") >= 2
    var = F.when(enough, loss(over_days("daily_quantile", days)))
    worst = F.when(enough, loss(over_days("_worst", days)))
    edge = (worst > 0) & (var >= worst * dbl(S.EDGE_RATIO))
    return out.select(
        *by,
        F.lit("historical").alias("method"),
        dbl(confidence).alias("confidence"),
        F.lit(days).alias("horizon_days"),
        var.alias("var_return"),
        _value(var, portfolio_value).alias("var_value"),
        "n_observations",
        "tail_observations",
        worst.alias("worst_observed_loss"),
        F.coalesce(edge, F.lit(False)).alias("at_the_edge"),
        messages(
            (~enough, "fewer than two returns"),
            (enough & (F.col("tail_observations") < S.MIN_TAIL), F.concat(F.lit("few tail observations: "), F.col("tail_observations"))),
            (edge, "close to the worst loss of the sample"),
        ).alias("warnings"),
    )


def rolling_historical_var(returns: DataFrame, window: int = 252, confidence: float = S.CONFIDENCE, by=BY, time: str = "d") -> DataFrame:
    """Adds var: the VaR of the last `window` rows, the current one included; NULL before. The quantile slides
    in O(log window) a row; a windowed percentile would sort its whole frame for each."""
    check(confidence)
    r = rolling_quantile(returns.where(present("r")), "r", window, 1.0 - confidence, "var", by, time)
    return r.withColumn("var", loss("var"))


def tail_count(n, confidence: float):
    """Rows in the tail by rank; the rounding keeps 1000 * (1 - 0.95) at 50."""
    return F.greatest(F.lit(1), F.ceil(F.round(col(n) * dbl(1.0 - confidence), 9))).cast("long")


def ranked(values: DataFrame, value: str, by) -> DataFrame:
    """Adds _rank from the smallest value of a series and _n, the number of its values."""
    w = whole(by).orderBy(value)
    return values.where(present(value)).withColumn("_rank", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole(by)))


def worst_rows(values: DataFrame, confidence: float, value: str = "r", by=BY) -> DataFrame:
    """The k smallest values of each series, exactly k whatever the ties."""
    return ranked(values, value, by).where(F.col("_rank") <= tail_count("_n", confidence)).drop("_rank", "_n")


def historical_es(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, by=BY) -> DataFrame:
    """The mean of the k worst log returns, scaled, as a loss."""
    check(confidence, days)
    inside = F.col("_rank") <= tail_count("_n", confidence)
    # Ranks, quantile and mean of a series all need its rows together: one shuffle serves them.
    out = ranked(returns, "r", by).groupBy(*by).agg(
        F.percentile("r", dbl(1.0 - confidence)).alias("_q"), F.count("*").alias("n_observations"), F.avg(F.when(inside, F.col("r"))).alias("_mean"), F.count_if(inside).alias("tail_observations")
    )
    out = out.where("n_observations >= 2").withColumn("var_return", loss(over_days("_q", days)))
    es = loss(over_days("_mean", days))
    return out.select(
        *by,
        F.lit("historical").alias("method"),
        dbl(confidence).alias("confidence"),
        F.lit(days).alias("horizon_days"),
        "var_return",
        es.alias("es_return"),
        _value(es, portfolio_value).alias("es_value"),
        "tail_observations",
        tail_severity(F.col("var_return"), es).alias("tail_severity"),
        messages((F.col("tail_observations") < S.MIN_TAIL, F.concat(F.lit("few tail observations: "), F.col("tail_observations")))).alias("warnings"),
    )


def tail_severity(var, es):
    return F.when(var > 0, es / F.nullif(var, F.lit(0.0)))


def fit_distribution(returns: DataFrame, by=BY) -> DataFrame:
    """Moments and the Jarque-Bera test. Skewness and kurtosis are those of the population; all
    shape columns are NULL below eight returns."""
    m = returns.where(present("r")).groupBy(*by).agg(
        F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("std"),
        F.skewness("r").alias("_s"),
        F.kurtosis("r").alias("_k"),
        F.count("*").alias("n_observations"),
    )
    enough = F.col("n_observations") >= 8
    s, k = F.when(enough, F.col("_s")), F.when(enough, F.col("_k"))
    jb = F.col("n_observations") / 6 * (s * s + k * k / 4)
    p = F.exp(-jb / 2)  # chi-square with two degrees of freedom
    return m.select(
        *by,
        "mean",
        "std",
        s.alias("skewness"),
        k.alias("excess_kurtosis"),
        jb.alias("jarque_bera"),
        p.alias("jarque_bera_p"),
        "n_observations",
        (p >= S.ALPHA).alias("is_normal"),
        (k > S.FAT_TAIL_KURTOSIS).alias("has_fat_tails"),
    )


def parametric_var(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, distribution: str = "normal", dof: DataFrame | None = None, by=BY) -> DataFrame:
    """VaR and ES of a fitted normal or Student-t distribution. The mean grows with the horizon,
    the deviation with its root. dof: by, dof (fitted if not given), used for "t" only."""
    check(confidence, days)
    tail = 1.0 - confidence
    fit = fit_distribution(returns, by).where("n_observations >= 8")
    mu, sigma = F.col("mean") * days, F.col("std") * dbl(math.sqrt(days))
    if distribution == "normal":
        z = normal_quantile(tail)
        fit = fit.withColumn("dof", F.lit(None).cast("double"))
        q, e = mu + dbl(z) * sigma, mu - sigma * dbl(normal_density(z)) / dbl(tail)
        warn = (~F.col("is_normal"), F.lit("the data reject a normal distribution"))
    elif distribution == "t":
        if dof is None:
            from .fit import degrees_of_freedom

            dof = degrees_of_freedom(returns, by)
        v = F.col("dof")
        fit = fit.join(dof.select(*by, "dof"), list(by)).withColumn("_z", t_quantile(dbl(tail), v)).withColumn("_f", t_density("_z", v))
        unit = F.sqrt((v - 2) / v)  # a Student-t has the variance v / (v - 2)
        q = mu + F.col("_z") * unit * sigma
        e = mu - sigma * unit * (v + F.col("_z") * F.col("_z")) / (v - 1) * F.col("_f") / dbl(tail)
        warn = (v >= S.DOF_RANGE[1], F.lit("so many degrees of freedom that it is a normal distribution"))
    else:
        raise ValueError(f"unknown distribution: {distribution!r}")
    var, es = loss(q), loss(e)
    return fit.select(
        *by,
        F.lit(f"parametric-{distribution}").alias("method"),
        dbl(confidence).alias("confidence"),
        F.lit(days).alias("horizon_days"),
        var.alias("var_return"),
        _value(var, portfolio_value).alias("var_value"),
        es.alias("es_return"),
        _value(es, portfolio_value).alias("es_value"),
        tail_severity(var, es).alias("tail_severity"),
        "dof",
        "is_normal",
        "n_observations",
        messages(warn).alias("warnings"),
    )


def normal_vs_historical(returns: DataFrame, confidence: float = S.CONFIDENCE, by=BY) -> DataFrame:
    """How far the empirical VaR is above the normal one."""
    p = parametric_var(returns, confidence, by=by).select(*by, F.col("var_return").alias("normal_var"))
    h = historical_var(returns, confidence, by=by).select(*by, F.col("var_return").alias("historical_var"))
    gap = F.col("historical_var") - F.col("normal_var")
    return p.join(h, list(by)).select(
        *by,
        "normal_var",
        "historical_var",
        gap.alias("gap"),
        F.when(F.col("normal_var") > 0, F.col("historical_var") / F.nullif("normal_var", F.lit(0.0))).alias("ratio"),
        F.when(gap > 0, "the normal tail is too thin").otherwise("the sample shows no worse tail").alias("reading"),
    )


def mark_breaches(series: DataFrame) -> DataFrame:
    """series: r and var side by side, as the rolling estimates have them. Adds realised_loss,
    is_breach and excess on the days that have both; no join."""
    j = series.where(present("r") & present("var")).withColumn("realised_loss", loss("r"))
    return j.withColumn("is_breach", (F.col("realised_loss") > F.col("var")).cast("int")).withColumn("excess", F.col("realised_loss") - F.col("var"))


def breaches(returns: DataFrame, var_series: DataFrame, by=BY, time: str = "d") -> DataFrame:
    """mark_breaches() for estimates that come from elsewhere: joined on series and day."""
    v = var_series.where(present("var")).select(*by, time, "var")
    return mark_breaches(returns.where(present("r")).select(*by, time, "r").join(v, [*by, time]))


def breach_rate(scored: DataFrame, by=BY) -> DataFrame:
    out = scored.groupBy(*by).agg(F.count("*").alias("n_days"), F.sum("is_breach").alias("n_breaches"))
    return out.withColumn("observed_rate", F.col("n_breaches") / F.col("n_days"))


def return_histogram(returns: DataFrame, bins: int = 120, by=BY) -> DataFrame:
    """Counts of simple returns in equal bins over each series' range; empty bins have no row."""
    r = returns.where(present("r")).select(*by, (F.exp("r") - 1).alias("s"))
    span = r.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    j = r.join(span, list(by))
    width = F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    k = F.least(F.coalesce(F.floor((F.col("s") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return j.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))
