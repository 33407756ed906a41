"""Validation, market measures and the variance recursion in one pass each."""

import math
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tailframe.operators import beta, composite, drawdown, fit, recursion, returns, tail, volatility
from tailframe.queries import QUERIES
from tailframe.sources import prices as sources

from .helpers import fat_returns, garch_returns, normal_returns, one, prices, table

DATA = "/root/testdata/sf0.001"


def scans(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("Relation [") + text.count("LogicalRDD ["), text


@pytest.fixture(scope="module")
def market(spark):
    named = {"a": 100 * np.exp(np.cumsum(fat_returns(400))), "b": 50 * np.exp(np.cumsum(normal_returns(90))), "two": [10.0, 11.0], "one": [5.0], "flat": [7.0] * 80, "short": 20 + np.arange(20.0)}
    return prices(spark, named).cache()


def test_measures_equal_the_operators(spark, market):
    bench = prices(spark, {"M": 100 * np.exp(np.cumsum(normal_returns(350, 3)))})
    got = {r.series_id: r for r in composite.market_measures(market, bench).collect()}
    r = returns.log_returns(market)
    each = lambda df: {x.series_id: x for x in df.collect()}
    vol, var, dd = each(volatility.historical_volatility(r)), each(tail.historical_var(r, 0.99)), each(drawdown.drawdown_summary(market))
    betas = each(beta.regression(beta.align(r, returns.log_returns(bench)), p_values=False))
    regime = each(volatility.regimes(volatility.rolling_volatility(r, 60)))
    assert set(got) == set(vol) == {"a", "b", "two", "flat", "short"}
    near = lambda x, y: x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))
    for k, g in got.items():
        assert near(g.volatility, vol[k].annualised)
        assert near(g.var_99, var[k].var_return)
        assert near(g.max_drawdown, dd[k].max_drawdown)
        assert near(g.beta, betas[k].beta_regression)
        assert g.beta_confidence == betas[k].confidence
        assert g.regime == (regime[k].regime if k in regime else "normal")


def test_gaps_do_not_stretch_frames(spark):
    """Days without a usable price have no return: 60 returns are 60 days with one."""
    values = list(100 * np.exp(np.cumsum(normal_returns(130))))
    values[40] = values[70] = -1.0
    p = prices(spark, {"a": values})
    r = returns.log_returns(p)
    want = one(volatility.regimes(volatility.rolling_volatility(r, 60)))
    assert one(composite.market_measures(p)).regime == want.regime
    assert one(composite.market_measures(p)).beta is None


def test_one_scan_and_one_aggregate_of_the_prices(market):
    plan = composite.market_measures(market)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan")[0].count("hashpartitioning") <= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_market_score_scans_prices_once_and_the_benchmark_once(spark):
    n, _ = scans(QUERIES["market_score"](spark, DATA))
    assert n == 2
    n, text = scans(QUERIES["validated_prices"](spark, DATA))
    assert n == 1
    assert "Join" not in text


def test_validation_refuses(spark):
    p = prices(spark, {"good": 100 + np.arange(60.0), "few": [1.0, 2.0, 3.0], "bad": [-1.0] * 40})
    kept = sources.validated(p, strict=False)
    assert {r.series_id for r in kept.collect()} == {"good"}
    assert kept.columns == p.columns
    with pytest.raises(PySparkException, match="few: too few observations"):
        sources.validated(p).collect()
    assert sources.validated(p.limit(0)).collect() == []


def test_validation_agrees_with_the_report(spark):
    rng = np.random.default_rng(2)
    named = {f"s{k}": np.where(rng.random(n) < 0.1, -1.0, 50 + rng.random(n)) for k, n in enumerate((29, 30, 31, 40, 200))}
    p = prices(spark, named)
    p = p.where((F.col("series_id") != "s4") | (F.unix_date("d") % 9 == 0))
    usable = {r.series_id for r in sources.quality_report(p).where("usable").collect()}
    assert {r.series_id for r in sources.validated(p, strict=False).collect()} == usable
    assert usable < set(named)


@pytest.mark.parametrize("part_rows", [37, 5000])
def test_variances_in_parts(spark, part_rows):
    x, y = garch_returns(900), garch_returns(120, seed=5)
    r = table(spark, {"x": x, "y": y, "none": [0.01] * 10})
    given = {"x": (0.05, 0.02, 0.1, 0.87, 0.7), "y": (0.0, 0.3, 0.2, 0.0, 1.0)}
    params = spark.createDataFrame([(k, *v) for k, v in given.items()], "series_id string, mean double, omega double, alpha double, beta double, first_variance double")
    v = recursion.long_variances(r, params, part_rows=part_rows)
    for name, values in (("x", x), ("y", y)):
        mean, omega, alpha, b, now = given[name]
        want, like = [], 0.0
        for e in np.asarray(values) * 100 - mean:
            want.append(now)
            like += -0.5 * (math.log(2 * math.pi) + math.log(now) + e * e / now)
            now = omega + alpha * e * e + b * now
        got = sorted(v.where(F.col("series_id") == name).collect(), key=lambda r: r.d)
        assert [g.variance for g in got] == pytest.approx(want, rel=1e-12)
        assert one(recursion.long_log_likelihood(v), series_id=name).log_likelihood == pytest.approx(like, rel=1e-12)
    assert v.where("series_id = 'none'").count() == 0


def test_the_long_recursion_is_the_fits(spark):
    """With the parameters of a fit, the variances of garch_series()."""
    r = table(spark, {"x": garch_returns(700)})
    f = one(fit.fit_garch(r, "normal"))
    series = sorted(fit.garch_series(r, "normal").collect(), key=lambda x: x.d)
    params = spark.createDataFrame([("x", f.mu if "mu" in f.asDict() else 0.0, f.omega, f.alpha, f.beta, series[0].conditional_volatility ** 2)], "series_id string, mean double, omega double, alpha double, beta double, first_variance double")
    got = sorted(recursion.long_variances(r, params, part_rows=100).collect(), key=lambda x: x.d)
    assert [g.variance for g in got] == pytest.approx([s.conditional_volatility**2 for s in series], rel=1e-6)


@pytest.mark.parametrize("p", [(0.02, 0.05, 0.1, 0.85), (0.02, 0.05, 0.1, 0.85, 5.0), (-0.1, 0.5, 0.3, 0.0, 30.0)])
def test_likelihood_and_slope_are_sums_over_parts(spark, p):
    x = garch_returns(400)
    r = table(spark, {"x": x})
    value, slope = recursion.LongSeries(r, part_rows=60).likelihood(p)
    want, by = fit.likelihood_and_slope(np.asarray(x) * 100, p)
    assert value == pytest.approx(want, rel=1e-12)
    assert slope.tolist() == pytest.approx(by.tolist(), rel=1e-9)
    assert recursion.LongSeries(r, part_rows=60).likelihood((0.0, -5.0, 0.1, 0.5)) == (-math.inf, None)


def test_a_long_fit_is_the_fit(spark):
    """The simulated process of the one-task tests, in parts."""
    r = table(spark, {"x": garch_returns(2000)})
    want = one(fit.fit_garch(r, "normal"))
    got = recursion.fit_long_garch(r, "normal", part_rows=700)
    assert got["log_likelihood"] == pytest.approx(want.log_likelihood, rel=1e-8)
    for c in ("omega", "alpha", "beta"):
        assert got[c] == pytest.approx(want[c], rel=1e-3)
    assert got["converged"]
    with pytest.raises(ValueError, match="fewer than"):
        recursion.fit_long_garch(r.limit(100), "normal")
