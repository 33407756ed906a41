"""Scorecards: annual ratios, market measures, valuation diagnostics and their composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dependence, known, mean_present, present, rating, score, weighted
from tailframe.plans import settings as S

LEVELS = ["interest_coverage", "debt_to_equity", "current_ratio", "cfo_to_net_income", "fcf_margin"]
TRENDS = ["interest_coverage", "current_ratio", "debt_to_equity", "ebitda_margin", "cfo_to_net_income"]
# What scores 0 and what scores 100.
LEVERAGE = [("debt_to_equity", 0.3, 3.0), ("interest_coverage", 15.0, 2.0)]
LIQUIDITY = ("current_ratio", 2.5, 0.8)
EARNINGS = [("sustained_conversion", 1.3, 0.6), ("fcf_margin", 0.20, -0.05)]
SLOPES = [("interest_coverage", 1.0, -2.0), ("current_ratio", 0.1, -0.2), ("debt_to_equity", -0.1, 0.4), ("ebitda_margin", 0.01, -0.03), ("cfo_to_net_income", 0.05, -0.15)]
MARKET = [("volatility", 0.15, 0.55, 0.30), ("var_99", 0.02, 0.08, 0.30), ("drawdown", 0.15, 0.60, 0.25), ("beta", 0.8, 2.5, 0.15)]
VALUATION = [("dependence", 0.40, 0.85, 0.40), ("fragility", 0.02, 0.08, 0.35), ("gap", 0.01, 0.05, 0.25)]


def recent_years(ratios: DataFrame, years: int = S.TREND_YEARS, by=("entity",), year: str = "fiscal_year") -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col(year).desc())
    return ratios.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(years, 3))


def slopes(recent: DataFrame, by=("entity",), year: str = "fiscal_year") -> DataFrame:
    """Least-squares slope of each ratio against its position among the years that have it (not
    against the year); NULL for fewer than three. Long form: by, metric, slope, n_years."""
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), known(m).alias("v")) for m in dict.fromkeys([*TRENDS, "fcf_margin"])))
    long = recent.select(*by, year, F.explode(parts).alias("_m")).select(*by, year, "_m.metric", "_m.v").where("v IS NOT NULL")
    x = (F.row_number().over(W.partitionBy(*by, "metric").orderBy(year)) - 1).cast("double")
    fit = long.withColumn("x", x).groupBy(*by, "metric").agg(F.count("*").alias("n_years"), F.covar_pop("x", "v").alias("_c"), F.var_pop("x").alias("_v"), F.avg("v").alias("mean"))
    return fit.select(*by, "metric", "n_years", "mean", F.when(F.col("n_years") >= 3, F.col("_c") / F.nullif("_v", F.lit(0.0))).alias("slope"))


def _flag(when: Column, category: str, severity: str, finding: str, evidence: Column) -> Column:
    return F.when(when, F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(finding).alias("finding"), evidence.cast("double").alias("evidence")))


def fundamental(ratios: DataFrame, years: int = S.TREND_YEARS, by=("entity",), year: str = "fiscal_year") -> DataFrame:
    """Pillars, overall risk, rating, flags and what was missing, one row an entity. Levels are those
    of the last year, slopes and the sustained conversion cover the recent ones."""
    recent = recent_years(ratios, years, by, year)
    last = recent.where("_rn = 1").select(*by, F.col(year).alias("last_year"), *(known(c).alias(c) for c in [*LEVELS, "ebitda_margin"]))
    pivot = [F.max(F.when(F.col("metric") == m, F.col("slope"))).alias(f"slope_{m}") for m in TRENDS]
    sustained = F.max(F.when((F.col("metric") == "cfo_to_net_income") & (F.col("n_years") >= 3), F.col("mean"))).alias("sustained_conversion")
    trend = slopes(recent, by, year).groupBy(*by).agg(*pivot, sustained)
    t = last.join(trend, list(by), "left")
    t = t.withColumn("leverage_risk", mean_present([score(*x) for x in LEVERAGE]))
    t = t.withColumn("liquidity_risk", score(*LIQUIDITY))
    t = t.withColumn("earnings_quality_risk", mean_present([score(*x) for x in EARNINGS]))
    t = t.withColumn("deterioration_risk", mean_present([score(f"slope_{c}", a, b) for c, a, b in SLOPES]))
    t = t.withColumn("overall_risk", mean_present([F.col(c) for c in ("leverage_risk", "liquidity_risk", "earnings_quality_risk", "deterioration_risk")]))
    cover, current, sus = F.col("interest_coverage"), F.col("current_ratio"), F.col("sustained_conversion")
    flags = [
        _flag(cover < 2.0, "Leverage", "critical", "interest cover is thin", cover),
        _flag((cover >= 2.0) & (cover < 4.0), "Leverage", "elevated", "interest cover leaves little headroom", cover),
        _flag(F.col("debt_to_equity") > 3.0, "Leverage", "critical", "debt is large against equity", F.col("debt_to_equity")),
        _flag(current < 0.8, "Liquidity", "critical", "short-term obligations exceed short-term assets", current),
        _flag((current >= 0.8) & (current < 1.0), "Liquidity", "watch", "working capital is tight", current),
        _flag(sus < 0.6, "Earnings quality", "critical", "profit isn't backed by operating cash", sus),
        _flag((sus >= 0.6) & (sus < 0.8), "Earnings quality", "elevated", "operating cash is below profit", sus),
        _flag(F.col("fcf_margin") < 0, "Cash generation", "elevated", "free cash flow is negative", F.col("fcf_margin")),
        _flag(F.col("slope_interest_coverage") < -1.0, "Deterioration", "elevated", "interest cover is falling", F.col("slope_interest_coverage")),
        _flag(F.col("slope_ebitda_margin") < -0.02, "Deterioration", "elevated", "the operating margin is shrinking", F.col("slope_ebitda_margin")),
        _flag(F.col("slope_debt_to_equity") > 0.3, "Deterioration", "elevated", "leverage is rising", F.col("slope_debt_to_equity")),
    ]
    t = t.withColumn("flags", F.array_compact(F.array(*flags)))
    t = t.withColumn("n_critical", F.size(F.filter("flags", lambda f: f["severity"] == "critical")))
    t = t.withColumn("unavailable", F.array_sort(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in LEVELS)))))
    return t.withColumn("rating", rating("overall_risk"))


def against_market(overall: Column, volatility: Column, peer: Column | None = None) -> tuple[Column, Column, Column]:
    """Market risk on the same scale, the gap and the verdict. A missing gap ends in agreement."""
    norm = score(volatility, 0.15, 0.55)
    if peer is not None:
        relative = F.greatest(F.lit(0.0), F.least(F.lit(2.0), volatility / F.nullif(peer, F.lit(0.0)))) / 2 * 100
        norm = F.when(peer > 0, F.when(present(volatility), relative)).otherwise(norm)
    gap = overall - norm
    verdict = F.when(gap > 25, "fundamental risk exceeds market risk").when(gap < -25, "market risk exceeds fundamental risk").otherwise("the two measures broadly agree")
    return norm, gap, verdict


def compare_with_market(fundamentals: DataFrame, volatility: str = "volatility", peer: str | None = None) -> DataFrame:
    market, gap, verdict = against_market(F.col("overall_risk"), F.col(volatility), F.col(peer) if peer else None)
    return fundamentals.withColumn("market_risk", market).withColumn("gap", gap).withColumn("verdict", verdict)


def score_market(measures: DataFrame) -> DataFrame:
    """measures: volatility, var_99, max_drawdown (negative), beta, beta_confidence, regime. A beta
    of low confidence isn't used; a regime moves the score a little, within 0 and 100."""
    low = F.coalesce(F.col("beta_confidence") == "low", F.lit(False))
    value = {"volatility": F.col("volatility"), "var_99": F.col("var_99"), "drawdown": F.abs("max_drawdown"), "beta": F.when(~low, F.col("beta"))}
    m = measures
    for name, a, b, _ in MARKET:
        m = m.withColumn(f"{name}_score", score(value[name], a, b))
    base = weighted([(F.col(f"{name}_score"), w) for name, _, _, w in MARKET])
    step = F.when(F.col("regime") == "elevated", S.REGIME_POINTS).when(F.col("regime") == "subdued", -S.REGIME_POINTS).otherwise(0.0)
    moved = F.when(base.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + step)))
    return m.withColumn("market_score", moved).withColumn("excluded", F.when(low & F.col("beta").isNotNull(), F.array(F.lit("beta"))).otherwise(F.array().cast("array<string>")))


def score_valuation(valuations: DataFrame) -> DataFrame:
    """valuations: terminal_share, wacc_sensitivity, wacc, market_implied_wacc."""
    value = {"dependence": F.col("terminal_share"), "fragility": F.abs("wacc_sensitivity"), "gap": F.abs(F.col("wacc") - F.col("market_implied_wacc"))}
    v = valuations
    for name, a, b, _ in VALUATION:
        v = v.withColumn(f"{name}_score", score(value[name], a, b))
    v = v.withColumn("valuation_score", weighted([(F.col(f"{name}_score"), w) for name, _, _, w in VALUATION]))
    return v.withColumn("assumption_dependence", dependence("terminal_share")).withColumn("is_fragile", F.coalesce(F.abs("wacc_sensitivity") > 0.05, F.lit(False)))


def compose(market: DataFrame, fundamentals: DataFrame | None = None, valuations: DataFrame | None = None, weights: dict[str, float] | None = None, by: str = "entity") -> DataFrame:
    """The composite of the dimensions that an entity has. Missing tables and missing rows are
    the same thing: a NULL side of a left join, weights renormalised and the dimension named.

    A valuation that exists but has no score loses its weight without being named as excluded.
    """
    w = dict(weights or S.COMPOSITE_WEIGHTS)
    out = market.select(by, "market_score", "volatility", "regime")
    if fundamentals is not None:
        out = out.join(fundamentals.select(by, F.lit(True).alias("_f"), F.col("overall_risk").alias("fundamental_score"), "deterioration_risk"), by, "left")
    else:
        out = out.withColumns({"_f": F.lit(None).cast("boolean"), "fundamental_score": F.lit(None).cast("double"), "deterioration_risk": F.lit(None).cast("double")})
    if valuations is not None:
        out = out.join(score_valuation(valuations).select(by, F.lit(True).alias("_v"), "valuation_score", "terminal_share", "wacc_sensitivity", "is_fragile"), by, "left")
    else:
        out = out.withColumns({"_v": F.lit(None).cast("boolean"), "valuation_score": F.lit(None).cast("double"), "terminal_share": F.lit(None).cast("double"), "wacc_sensitivity": F.lit(None).cast("double"), "is_fragile": F.lit(None).cast("boolean")})
    parts = {k: F.col(f"{k}_score") for k in ("market", "fundamental", "valuation")}
    total = sum((F.when(present(c) & c.isNotNull(), F.lit(float(w[k]))).otherwise(F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    used = F.map_from_entries(F.array_compact(F.array(*(F.when(present(c) & c.isNotNull() & (total > 0), F.struct(F.lit(k), F.lit(float(w[k])) / F.nullif(total, F.lit(0.0)))) for k, c in parts.items()))))
    out = out.withColumn("overall", weighted([(c, w[k]) for k, c in parts.items()])).withColumn("weights_used", used)
    out = out.withColumn("excluded_dimensions", F.array_compact(F.array(F.when(F.col("_f").isNull(), F.lit("fundamental")), F.when(F.col("_v").isNull(), F.lit("valuation")))))
    _, gap, verdict = against_market(F.col("fundamental_score"), F.col("volatility"))
    case = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    found = [
        case(F.col("_f") & (gap > 25), "fundamental_vs_market", "critical"),
        case(F.col("_f") & (gap < -25), "fundamental_vs_market", "note"),
        case(F.col("is_fragile") & (F.col("regime") == "elevated"), "valuation_vs_regime", "elevated"),
        case((F.col("deterioration_risk") > 50) & (F.col("terminal_share") > 0.70), "deteriorating_vs_terminal", "elevated"),
    ]
    out = out.withColumn("divergences", F.array_compact(F.array(*found))).withColumn("verdict", F.when(F.col("_f"), verdict))
    return out.withColumn("rating", rating("overall")).drop("_f", "_v")
