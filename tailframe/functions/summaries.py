"""One-line readings of result rows, as column expressions over their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(pattern: str, *columns) -> Column:
    """NULL if any part is NULL, rather than a text that says null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull()
    return F.when(ok, F.format_string(pattern, *parts))


def pct(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * 100


def var_summary() -> Column:
    return _text("%s VaR, %.0f%% over %d day(s): a loss of %.2f%% or more", F.initcap("method"), pct("confidence"), "horizon_days", pct("var_return"))


def es_summary() -> Column:
    return _text("%s ES, %.0f%% over %d day(s): %.2f%% on average beyond a VaR of %.2f%%", F.initcap("method"), pct("confidence"), "horizon_days", pct("es_return"), pct("var_return"))


def simulation_summary() -> Column:
    return _text("%s VaR of %d paths, %.0f%% over %d day(s): %.2f%% (standard error %.3f%%)", F.initcap("method"), "paths", pct("confidence"), "horizon_days", pct("var_return"), pct("standard_error"))


def distribution_verdict() -> Column:
    reject = _text("a normal distribution is rejected: excess kurtosis %.2f", "excess_kurtosis")
    return F.when(F.col("is_normal"), _text("a normal distribution isn't rejected (p = %.3f)", "jarque_bera_p")).otherwise(reject)


def arch_reading() -> Column:
    return F.when(F.col("has_arch_effects"), _text("volatility clusters (p = %.3g)", "p_value")).otherwise(_text("no clustering found (p = %.3f)", "p_value"))


def garch_summary() -> Column:
    life = F.when(F.col("is_stationary"), _text("a shock halves in %.0f days", "half_life_days")).otherwise("shocks don't decay")
    return _text("persistence %.3f: %s; volatility now %.1f%%, over the sample %.1f%%", "persistence", life, pct("current_annualised"), pct("realised_annualised"))


def backtest_reading() -> Column:
    return _text("%d breaches in %d days, %.2f%% against %.2f%% expected: %s", "n_breaches", "n_observations", pct("observed_rate"), pct("expected_rate"), "verdict")


def portfolio_summary() -> Column:
    return _text("%d holdings that count as %.1f; volatility %.1f%%, %.1f%% without diversification", "n_holdings", "effective_holdings", pct("annualised_volatility"), pct("weighted_average_volatility"))


def fundamental_summary() -> Column:
    return _text("fundamental risk %.0f of 100 (%s), %d flag(s), %d critical", "overall_risk", "rating", F.size("flags"), "n_critical")


def valuation_summary() -> Column:
    return _text("%.0f%% of the value lies beyond the forecast (%s dependence); 25 basis points move it by %.1f%%", pct("terminal_share"), F.lower("assumption_dependence"), pct(F.abs("wacc_sensitivity")))


def composite_summary() -> Column:
    left_out = F.when(F.size("excluded_dimensions") > 0, F.concat(F.lit("; without "), F.array_join("excluded_dimensions", ", "))).otherwise("")
    found = F.when(F.size("divergences") > 0, F.format_string("; %d divergence(s)", F.size("divergences"))).otherwise("")
    return F.concat(_text("composite risk %.0f of 100 (%s)", "overall", "rating"), left_out, found)
