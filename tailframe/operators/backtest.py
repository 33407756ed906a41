"""Backtests of VaR series: coverage, independence, zones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import basel_zone, dbl, messages
from tailframe.functions.distributions import chi2_tail_1
from tailframe.plans import settings as S

from .frames import BY, ordered, so_far, whole

#: Where the statistics are rejected at 5%: quantiles of chi-square with 1 and 2 degrees of freedom.
LIMIT_1, LIMIT_2 = 3.841458820694124, 5.991464547107979


def _xlog(n, p):
    return F.when(p > 0, n * F.ln(p)).otherwise(dbl(0))


def longest_runs(scored: DataFrame, by=BY, time: str = "d") -> DataFrame:
    """The longest run of breaches: gaps and islands on (row number - breaches so far)."""
    island = F.row_number().over(ordered(by, time)) - F.sum("is_breach").over(so_far(by, time))
    runs = scored.select(*by, time, "is_breach").withColumn("_island", island).groupBy(*by, "_island").agg(F.sum("is_breach").alias("_run"))
    return runs.groupBy(*by).agg(F.max("_run").cast("long").alias("max_consecutive"))


def transition_counts(scored: DataFrame, by=BY, time: str = "d") -> DataFrame:
    """Days, breaches, the four transitions between neighbouring days and the longest run of breaches: one
    window pass, whose rows are counted by island (a value of rows - breaches so far) and then by series."""
    w = ordered(by, time)
    island = F.row_number().over(w) - F.sum("is_breach").over(so_far(by, time))
    t = scored.select(*by, time, "is_breach", F.lag("is_breach").over(w).alias("_before"), island.alias("_island"))
    pair = lambda a, b: F.count_if((F.col("_before") == a) & (F.col("is_breach") == b))
    sums = {"n_observations": F.count("*"), "n_breaches": F.sum("is_breach"), **{f"n{a}{b}": pair(a, b) for a in (0, 1) for b in (0, 1)}}
    islands = t.groupBy(*by, "_island").agg(*(c.alias(n) for n, c in sums.items()))
    return islands.groupBy(*by).agg(*(F.sum(n).cast("long").alias(n) for n in sums), F.max("n_breaches").cast("long").alias("max_consecutive"))


def kupiec(n, breaches, expected_rate: float):
    """The likelihood ratio of coverage, with its limits for no and for only breaches."""
    p, q = math.log(expected_rate), math.log(1 - expected_rate)
    rate = breaches / F.nullif(n, F.lit(0))
    general = -2 * (breaches * dbl(p) + (n - breaches) * dbl(q) - breaches * F.ln(rate) - (n - breaches) * F.ln(1 - rate))
    return F.when(n == 0, F.lit(None).cast("double")).when(breaches == 0, -2 * n * dbl(q)).when(breaches == n, -2 * n * dbl(p)).otherwise(general)


def christoffersen(n00, n01, n10, n11):
    """The likelihood ratio of independence; 0 where it isn't identified."""
    ratio = lambda a, b: a / F.nullif(b.cast("double"), dbl(0))
    p01, p11, p = ratio(n01, n00 + n01), ratio(n11, n10 + n11), ratio(n01 + n11, n00 + n01 + n10 + n11)
    null = _xlog(n00 + n10, 1 - p) + _xlog(n01 + n11, p)
    alternative = _xlog(n00, 1 - p01) + _xlog(n01, p01) + _xlog(n10, 1 - p11) + _xlog(n11, p11)
    unclear = (n01 + n11 == 0) | (n00 + n01 == 0) | (n10 + n11 == 0) | (n00 + n10 == 0)
    return F.when(unclear, dbl(0)).otherwise(F.greatest(-2 * (null - alternative), dbl(0)))


def backtest(scored: DataFrame, confidence: float = S.CONFIDENCE, alpha: float = S.ALPHA, by=BY, time: str = "d", p_values: bool = True) -> DataFrame:
    """One row for each series (and model, if it's among `by`) of breaches(). Without p_values the
    passes at alpha = 0.05 come from the statistics."""
    rate = 1.0 - confidence  # a float on purpose: 0.050000000000000044
    out = transition_counts(scored, by, time)
    n, b = F.col("n_observations"), F.col("n_breaches")
    out = out.select(
        *by,
        "n_observations",
        "n_breaches",
        (n * dbl(rate)).alias("expected_breaches"),
        (b / n).alias("observed_rate"),
        dbl(rate).alias("expected_rate"),
        kupiec(n, b, rate).alias("kupiec_statistic"),
        F.when(n < 2, F.lit(None).cast("double")).otherwise(christoffersen(*map(F.col, ("n00", "n01", "n10", "n11")))).alias("christoffersen_statistic"),
        "max_consecutive",
    )
    out = out.withColumn("joint_statistic", F.col("kupiec_statistic") + F.col("christoffersen_statistic"))
    if p_values:
        # Identified or not, a statistic of 0 has the p-value 1.
        out = out.withColumn("kupiec_p", chi2_tail_1("kupiec_statistic")).withColumn("christoffersen_p", chi2_tail_1("christoffersen_statistic"))
        out = out.withColumn("joint_p", F.exp(-F.col("joint_statistic") / 2))
        passes = {"coverage": F.col("kupiec_p") >= alpha, "independence": F.col("christoffersen_p") >= alpha, "joint": F.col("joint_p") >= alpha}
    elif alpha == S.ALPHA:
        passes = {"coverage": F.col("kupiec_statistic") <= LIMIT_1, "independence": F.col("christoffersen_statistic") <= LIMIT_1, "joint": F.col("joint_statistic") <= LIMIT_2}
    else:
        raise ValueError("without p-values only alpha = 0.05 is known")
    for name, ok in passes.items():
        out = out.withColumn(f"passes_{name}", ok)
    cover, alone = F.col("passes_coverage"), F.col("passes_independence")
    out = out.withColumn(
        "verdict",
        F.when(cover & alone, "not rejected")
        .when(~cover & ~alone, "rejected on count and clustering")
        .when(~cover, F.when(F.col("observed_rate") > F.col("expected_rate"), "rejected on count: too many").otherwise("rejected on count: too few"))
        .otherwise("rejected on clustering"),
    )
    return out.withColumn("warnings", messages((n < S.LOW_POWER, "few observations: low power"), (b == 0, "no breaches: too conservative")))


def compare(scored: DataFrame, confidence: float = S.CONFIDENCE, by=(*BY, "model"), time: str = "d", p_values: bool = True) -> DataFrame:
    """The table of models: scored has a column model among `by`."""
    t = backtest(scored, confidence, S.ALPHA, by, time, p_values)
    word = lambda c: F.when(F.col(c), "pass").otherwise("FAIL")
    tests = ["kupiec_p", "christoffersen_p", "joint_p"] if p_values else ["kupiec_statistic", "christoffersen_statistic", "joint_statistic"]
    return t.select(
        *by, F.col("n_breaches").alias("breaches"), F.round("expected_breaches", 1).alias("expected"), F.col("observed_rate").alias("rate"), *tests, word("passes_coverage").alias("coverage"), word("passes_independence").alias("independence"), F.col("max_consecutive").alias("max_run")
    )


def basel(scored: DataFrame, days: int | None = S.BASEL_DAYS, by=BY, time: str = "d") -> DataFrame:
    """The zone of the last `days` scored days of each series (all days: None)."""
    s = scored
    if days:
        s = s.withColumn("_rn", F.row_number().over(whole(by).orderBy(F.col(time).desc()))).where(F.col("_rn") <= days)
    out = s.groupBy(*by).agg(F.sum("is_breach").cast("long").alias("n_breaches"), F.count("*").alias("n_days"))
    scale = F.col("n_days") / dbl(S.BASEL_DAYS)
    out = out.withColumn("green_max", scale * S.BASEL_GREEN).withColumn("yellow_max", scale * S.BASEL_YELLOW)
    return out.withColumn("zone", basel_zone("n_breaches", "n_days")).withColumn("exact_window", F.col("n_days") == S.BASEL_DAYS)
