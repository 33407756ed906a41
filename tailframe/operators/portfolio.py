"""Portfolios of series: alignment, covariance, contributions, ratios, weights.

Everything stays long: a portfolio is rows (portfolio_id, series_id, w), and its covariance
matrix is rows (portfolio_id, i, j).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, loss, messages, present
from tailframe.plans import settings as S
from tailframe.plans.storage import stored

from . import gram
from .drawdown import curve_drawdown
from .gram import P, SID, minimum_variance

__all__ = ["P", "SID", "minimum_variance"]


def equal_weights(members: DataFrame) -> DataFrame:
    """members: portfolio_id, series_id."""
    return members.withColumn("w", 1.0 / F.count("*").over(W.partitionBy(P)))


def normalised(weights: DataFrame) -> DataFrame:
    """Weights that add up to 1; short positions are allowed. A portfolio whose weights add up to
    nothing fails."""
    total = F.sum("w").over(W.partitionBy(P))
    bad = F.abs(total) <= 1e-8
    return weights.withColumn("w", F.when(bad, F.raise_error(F.lit("weights sum to zero")).cast("double")).otherwise(F.col("w") / total))


def parse_weights(text: str, names: list[str]) -> list[tuple[str, float]]:
    """Weights typed as "0.5, 0.3, 0.2" for the names in order; blanks mean equal weights."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts:
        return [(n, 1.0 / len(names)) for n in names]
    if len(parts) != len(names):
        raise ValueError(f"{len(parts)} weights for {len(names)} names")
    return [(n, float(p.rstrip("%")) / (100.0 if p.endswith("%") else 1.0)) for n, p in zip(names, parts, strict=True)]


def missing_members(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Members without any return: an anti-join on distinct series."""
    return weights.join(returns.where(present("r")).select(SID).distinct(), SID, "left_anti").select(P, SID)


def aligned(returns: DataFrame, weights: DataFrame, least: int | None = S.MIN_OVERLAP, already_simple: bool = False, time: str = "d") -> DataFrame:
    """portfolio_id, series_id, d, s (simple return), w on the days that all members have. Portfolios
    of fewer than two members, or of fewer than `least` common days, are left out."""
    w = normalised(weights).withColumn("_members", F.count("*").over(W.partitionBy(P)))
    s = F.col("r") if already_simple else F.exp("r") - 1
    j = returns.where(present("r")).select(SID, time, s.alias("s")).join(w.where("_members >= 2"), SID)
    # A day's rows of one portfolio are at most its members, so they can be gathered; no join of the
    # rows with the complete days is needed.
    days = j.groupBy(P, time).agg(F.collect_list(F.struct(SID, "s", "w")).alias("_rows"), F.first("_members").alias("_m")).where("size(_rows) = _m")
    if least:
        usable = days.groupBy(P).agg(F.count("*").alias("_days")).where(F.col("_days") >= least).select(P)
        days = days.join(usable, P, "left_semi")
    return days.select(P, time, F.inline("_rows")).select(P, SID, time, "s", "w")


def covariance_pairs(panel: DataFrame, time: str = "d") -> DataFrame:
    """portfolio_id, i, j (i <= j): annual sample covariance and correlation. The pairs are made from
    each day's members, which are together already, and partial sums leave the map side: N(N+1)/2
    rows a portfolio."""
    days = panel.groupBy(P, time).agg(F.collect_list(F.struct(SID, "s", "w")).alias("_rows"))
    days = days.select(P, "_rows", F.explode("_rows").alias("_a"))
    pairs = days.select(P, "_a", F.explode(F.filter("_rows", lambda b: b[SID] >= F.col("_a")[SID])).alias("_b"))
    pairs = pairs.select(P, *(F.col(f"{side}.{c}").alias(name) for side, names in (("_a", "i x wi"), ("_b", "j y wj")) for c, name in zip((SID, "s", "w"), names.split(), strict=True)))
    m = pairs.groupBy(P, "i", "j").agg(
        F.covar_samp("x", "y").alias("c"), F.stddev_samp("x").alias("_sx"), F.stddev_samp("y").alias("_sy"), F.first("wi").alias("wi"), F.first("wj").alias("wj"), F.count("*").alias("n")
    )
    return m.select(P, "i", "j", "wi", "wj", "n", (F.col("c") * S.TRADING_DAYS).alias("cov"), (F.col("c") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))).alias("corr"))


def all_pairs(panel: DataFrame, time: str = "d") -> DataFrame:
    """covariance_pairs(), by tiles of members where a portfolio has more than a few."""
    most = panel.select(P, SID).distinct().groupBy(P).count().agg(F.max("count")).first()[0] or 0
    return covariance_pairs(panel, time) if most <= gram.FEW_MEMBERS else gram.covariance_tiles(panel, time)


def both_triangles(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders, made from its one row."""
    row = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(f"w{i}").alias("wi"), F.col(f"w{j}").alias("wj"), "n", "cov", "corr")
    return pairs.select(P, F.inline(F.when(F.col("i") == F.col("j"), F.array(row("i", "j"))).otherwise(F.array(row("i", "j"), row("j", "i")))))


def contributions(pairs: DataFrame) -> DataFrame:
    """Of each member: weight, own volatility, marginal, absolute and relative risk contribution.
    The contributions of a portfolio add up to its volatility."""
    each = both_triangles(pairs).groupBy(P, F.col("i").alias(SID)).agg(
        F.sum(F.col("wj") * F.col("cov")).alias("_m"), F.first("wi").alias("w"), F.max(F.when(F.col("i") == F.col("j"), F.sqrt(F.greatest("cov", F.lit(0.0))))).alias("own_volatility")
    )
    variance = F.sum(F.col("w") * F.col("_m")).over(W.partitionBy(P))
    each = each.withColumn("_vol", F.sqrt(F.greatest(variance, F.lit(0.0))))
    marginal = F.when(F.col("_vol") > 0, F.col("_m") / F.nullif("_vol", F.lit(0.0))).otherwise(F.lit(0.0))
    each = each.withColumn("marginal", marginal).withColumn("contribution", F.col("w") * F.col("marginal"))
    share = F.when(F.col("_vol") > 0, F.col("contribution") / F.nullif("_vol", F.lit(0.0))).otherwise(F.lit(0.0))
    return each.select(P, SID, "w", "own_volatility", "marginal", "contribution", share.alias("share"), F.col("_vol").alias("portfolio_volatility"))


def daily_returns(panel: DataFrame, time: str = "d") -> DataFrame:
    return panel.groupBy(P, time).agg(F.sum(F.col("w") * F.col("s")).alias("r"))


def log_series(panel: DataFrame, time: str = "d") -> DataFrame:
    """The portfolio's log returns, for every single-series operator; days that lose all are left out."""
    d = daily_returns(panel, time).where("r > -1")
    return d.select(F.col(P).alias(SID), time, F.ln(F.col("r") + 1).alias("r"))


def ratios(panel: DataFrame, risk_free: float = 0.0, time: str = "d") -> DataFrame:
    """Annual return, Sharpe, Sortino (downside over all days) and the curve's drawdown."""
    d = daily_returns(panel, time)
    e = F.col("r") - dbl(risk_free / S.TRADING_DAYS)
    m = d.groupBy(P).agg(F.count("*").alias("n_observations"), F.avg("r").alias("_mr"), F.avg(e).alias("_me"), F.stddev_samp("r").alias("_sd"), F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), F.lit(2.0)))).alias("_down"))
    year = dbl(math.sqrt(S.TRADING_DAYS))
    over = lambda c: F.when(F.col(c) > 0, F.col("_me") / F.nullif(c, F.lit(0.0)) * year)
    out = m.select(P, "n_observations", (F.col("_mr") * S.TRADING_DAYS).alias("annualised_return"), over("_sd").alias("sharpe"), over("_down").alias("sortino"))
    return out.join(curve_drawdown(d, (P,), time), P)


def concentration(contribution: DataFrame) -> DataFrame:
    m = contribution.groupBy(P).agg(
        F.count("*").alias("n_holdings"),
        F.sum(F.col("w") * F.col("w")).alias("herfindahl"),
        F.max_by(SID, F.struct(F.abs("w"), F.col(SID))).alias("heaviest"),
        F.max(F.abs("w")).alias("heaviest_weight"),
        F.sum(F.abs("w") * F.col("own_volatility")).alias("weighted_average_volatility"),
        F.max("portfolio_volatility").alias("annualised_volatility"),
    )
    m = m.withColumn("effective_holdings", 1 / F.nullif("herfindahl", F.lit(0.0)))
    m = m.withColumn("diversification_ratio", F.when(F.col("annualised_volatility") > 0, F.col("weighted_average_volatility") / F.nullif("annualised_volatility", F.lit(0.0))))
    m = m.withColumn("risk_reduction", F.when(F.col("weighted_average_volatility") > 0, 1 - F.col("annualised_volatility") / F.nullif("weighted_average_volatility", F.lit(0.0))))
    return m.withColumn("is_concentrated", F.col("effective_holdings") < F.col("n_holdings") * dbl(S.CONCENTRATED))


def same_bets(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("i") < F.col("j")) & (F.col("corr") > S.SAME_BET)).select(P, "i", "j", "corr")


def analyse(returns: DataFrame, weights: DataFrame, risk_free: float = 0.0, already_simple: bool = False, time: str = "d") -> DataFrame:
    """One row a portfolio, with its members' contributions and its warnings nested."""
    panel = stored(aligned(returns, weights, S.MIN_OVERLAP, already_simple, time), "panel")  # read six times below
    pairs = stored(all_pairs(panel, time), "pairs")
    each = contributions(pairs)
    members = each.groupBy(P).agg(F.array_sort(F.collect_list(F.struct(SID, "w", "own_volatility", "marginal", "contribution", "share"))).alias("members"), F.count_if(F.col("contribution") < 0).alias("_hedges"), F.count_if(F.col("w") < 0).alias("_shorts"))
    bets = same_bets(pairs).groupBy(P).agg(F.array_sort(F.collect_list(F.struct("i", "j", "corr"))).alias("same_bets"))
    out = concentration(each).join(ratios(panel, risk_free, time), P).join(members, P).join(bets, P, "left")
    notes = messages(
        (F.col("is_concentrated"), F.concat(F.lit("concentrated in "), F.col("heaviest"))),
        (F.col("same_bets").isNotNull(), "members that are nearly the same bet"),
        (F.col("_hedges") > 0, "members that lower the risk"),
        (F.col("_shorts") > 0, "short positions"),
        (F.col("sortino") > F.col("sharpe") * 1.3, "much of the volatility is upside"),
    )
    return out.withColumn("notes", notes).drop("_hedges", "_shorts")


def component_var_sum(var: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted sum of the members' own VaRs (column var_return)."""
    return normalised(weights).join(var, SID).groupBy(P).agg(F.sum(F.abs("w") * F.col("var_return")).alias("component_var"))


def es_shortfall(es_historical: DataFrame, es_normal: DataFrame, by=("series_id",)) -> DataFrame:
    """The share of the empirical ES that a normal one misses."""
    h = es_historical.select(*by, F.col("es_return").alias("es_historical"))
    n = es_normal.select(*by, F.col("es_return").alias("es_normal"))
    return h.join(n, list(by)).withColumn("shortfall", (F.col("es_historical") - F.col("es_normal")) / F.nullif("es_historical", F.lit(0.0)))


def loss_series(returns: DataFrame) -> DataFrame:
    return returns.withColumn("realised_loss", loss("r"))
