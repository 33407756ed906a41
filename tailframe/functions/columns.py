"""Scalar expressions. Missing is NULL throughout; nothing here leaves the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailframe.plans import settings as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    """A DOUBLE literal: in SQL text 0.05 would be a DECIMAL."""
    return F.lit(float(x))


def present(c: Column | str) -> Column:
    return col(c).isNotNull() & ~F.isnan(col(c))


def known(c: Column | str) -> Column:
    """The value, with NaN as NULL."""
    return F.when(~F.isnan(col(c)), col(c))


def loss(log_return: Column | str) -> Column:
    """A log return as a positive simple loss."""
    return -(F.exp(col(log_return)) - 1)


def simple(log_return: Column | str) -> Column:
    return F.exp(col(log_return)) - 1


def over_days(log_quantile: Column | str, days: int) -> Column:
    return col(log_quantile) * dbl(math.sqrt(days))


def annual_volatility(sigma: Column | str, periods: int = S.TRADING_DAYS) -> Column:
    return col(sigma) * dbl(math.sqrt(periods))


def annual_return(mean: Column | str, periods: int = S.TRADING_DAYS, method: str = "log") -> Column:
    if method == "log":
        return col(mean) * periods
    if method == "simple":
        return F.pow(1 + col(mean), dbl(periods)) - 1
    raise ValueError(f"unknown return method: {method}")


def score(value: Column | str, safe: float, dangerous: float) -> Column:
    """0 at `safe` and 100 at `dangerous`, linear between and clamped; NULL for missing.
    least() and greatest() skip NULLs, so missing has to be kept out of them."""
    v = col(value)
    if safe == dangerous:
        return F.lit(None).cast("double")
    return F.when(present(v), F.greatest(dbl(0), F.least(dbl(1), (v - dbl(safe)) / dbl(dangerous - safe))) * 100)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that are present, weights renormalised; NULL if none is."""
    total = sum((F.when(present(c), dbl(w)).otherwise(dbl(0)) for c, w in parts), dbl(0))
    top = sum((F.when(present(c), c * dbl(w)).otherwise(dbl(0)) for c, w in parts), dbl(0))
    return F.when(total > 0, top / total)


def mean_present(parts: list[Column]) -> Column:
    return weighted([(c, 1.0) for c in parts])


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_density(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def chi2_tail_even(x: Column | str, df: int) -> Column:
    """Survival function of chi-square with an even number of degrees of freedom, in closed form."""
    half = col(x) / 2
    return F.exp(-half) * sum((F.pow(half, dbl(k)) / dbl(math.factorial(k)) for k in range(df // 2)), dbl(0))


def volatility_regime(current: Column | str, average: Column | str) -> Column:
    """Against the series' own mean; bounds belong to the outer bands."""
    c, a = col(current), col(average)
    ratio = c / F.nullif(a, dbl(0))
    return F.when(~present(ratio), "unknown").when(ratio.isNull(), "unknown").when(ratio >= S.REGIME_HIGH, "elevated").when(ratio <= S.REGIME_LOW, "subdued").otherwise("normal")


def conditional_regime(current: Column | str, realised: Column | str) -> Column:
    """Against realised volatility; strict bounds."""
    c, r = col(current), col(realised)
    return F.when(c > r * 1.25, "elevated").when(c < r * 0.8, "subdued").otherwise("normal")


def rating(risk: Column | str) -> Column:
    r = col(risk)
    return F.when(r >= 70, "High").when(r >= 50, "Elevated").when(r >= 30, "Moderate").otherwise("Low")


def dependence(terminal_share: Column | str) -> Column:
    t = col(terminal_share)
    return F.when(t >= 0.85, "Critical").when(t >= 0.70, "High").when(t >= 0.5, "Moderate").otherwise("Low")


def beta_confidence(n: Column | str, r_squared: Column | str) -> Column:
    return F.when(col(n) < 30, "low").when(col(r_squared) >= 0.30, "high").when(col(r_squared) >= 0.10, "medium").otherwise("low")


def basel_zone(breaches: Column | str, days: Column | str) -> Column:
    scale = col(days) / dbl(S.BASEL_DAYS)
    return F.when(col(breaches) <= scale * S.BASEL_GREEN, "green").when(col(breaches) <= scale * S.BASEL_YELLOW, "yellow").otherwise("red")


def freshness(fetched_at: Column | str, now: Column) -> Column:
    """DELAYED for a day, then STALE; never live."""
    return F.when(col(fetched_at) >= now - F.expr(f"INTERVAL {S.STALE_AFTER_HOURS} HOURS"), "DELAYED").otherwise("STALE")


def cache_safe(name: Column | str) -> Column:
    """A series' name as a file name."""
    return F.translate(col(name), "^/", "__")


def trend_label(slope: Column | str, higher_is_worse: bool = False) -> Column:
    s = -col(slope) if higher_is_worse else col(slope)
    return F.when(~present(col(slope)) | col(slope).isNull(), "unknown").when(s > 0, "improving").when(s < 0, "worsening").otherwise("flat")


def messages(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(when, text if isinstance(text, Column) else F.lit(text)) for when, text in rules)))
