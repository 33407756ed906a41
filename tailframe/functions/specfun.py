"""Student-t and chi-square functions in numpy, and pandas UDFs over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _betacf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return out


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_cdf(x: float, v: float) -> float:
    # Near 0 the complement is the accurate one of the two forms.
    tail = 0.5 * (betainc(v / 2.0, 0.5, v / (v + x * x)) if x * x > 1.0 else 1.0 - betainc(0.5, v / 2.0, x * x / (v + x * x)))
    return tail if x < 0 else 1.0 - tail


def t_pdf(x: float, v: float) -> float:
    return math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * math.log1p(x * x / v))


def t_ppf(p: float, v: float) -> float:
    """Quantile: bisection on a bracket, then Newton steps."""
    if p == 0.5:
        return 0.0
    if p > 0.5:
        return -t_ppf(1.0 - p, v)
    low, high = -1.0, 0.0
    while t_cdf(low, v) > p:
        low, high = low * 2.0, low
    for _ in range(60):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_cdf(mid, v) < p else (low, mid)
    x = (low + high) / 2.0
    for _ in range(3):
        x -= (t_cdf(x, v) - p) / t_pdf(x, v)
    return x


def t_two_sided(t: float, v: float) -> float:
    return betainc(v / 2.0, 0.5, v / (v + t * t))


def chi2_tail_1(x: float) -> float:
    return math.erfc(math.sqrt(max(x, 0.0) / 2.0))


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p1(x: pd.Series) -> pd.Series:
    return _each(chi2_tail_1, x)


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, v: pd.Series) -> pd.Series:
    return _each(t_ppf, p, v)


@F.pandas_udf(DoubleType())
def t_density(x: pd.Series, v: pd.Series) -> pd.Series:
    return _each(t_pdf, x, v)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, v: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, v)


