import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe import queries
from tailframe.functions import specfun
from tailframe.operators import fit
from tailframe.plans import settings as S

from .helpers import fat_returns, garch_returns, normal_returns, one, ordered, table


@pytest.mark.parametrize("v", [2.5, 3.7, 10.0, 250.0])
def test_student_t_round_trip(v):
    for p in (1e-4, 0.01, 0.05, 0.3, 0.5, 0.9):
        assert specfun.t_cdf(specfun.t_ppf(p, v), v) == pytest.approx(p, abs=1e-10)
    x = np.linspace(-4, 4, 9)
    slope = [(specfun.t_cdf(a + 1e-5, v) - specfun.t_cdf(a - 1e-5, v)) / 2e-5 for a in x]
    assert slope == pytest.approx([specfun.t_pdf(a, v) for a in x], rel=1e-6)


def test_known_values():
    assert specfun.t_ppf(0.05, 4) == pytest.approx(-2.13184678632665, abs=1e-9)
    assert specfun.t_ppf(0.01, 1) == pytest.approx(math.tan(math.pi * (0.01 - 0.5)), rel=1e-9)
    assert specfun.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert specfun.chi2_tail_1(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert fit.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert fit.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)


def test_degrees_of_freedom(spark):
    t = table(spark, {"F": fat_returns(4000), "N": normal_returns(4000), "S": [0.1, 0.2]})
    got = {r.series_id: r.dof for r in fit.degrees_of_freedom(t).collect()}
    assert 2.5 <= got["F"] < 3.6
    assert got["N"] > 25
    assert got["S"] is None
    v, mu, s = fit.fit_t(fat_returns(4000))
    best = fit.t_location_scale(fat_returns(4000), v)[2]
    assert all(fit.t_location_scale(fat_returns(4000), v * k)[2] <= best for k in (0.95, 1.05))


def test_arch_lm():
    assert fit.arch_lm(garch_returns())[1] < 0.001
    assert fit.arch_lm(normal_returns(1500, 5, 0.0003, 0.01))[1] > 0.05
    with pytest.raises(ValueError, match="more than"):
        fit.arch_lm(np.zeros(11))


@pytest.fixture(scope="module")
def fits(spark):
    t = table(spark, {"G": garch_returns(), "S": garch_returns(100)}).cache()
    return t, fit.fit_garch(t, "normal").cache(), fit.fit_garch(t.where("series_id = 'G'"), "t").cache()


def test_garch_recovers_its_parameters(fits):
    for f in (one(fits[1], series_id="G"), one(fits[2])):
        assert abs(f.alpha - 0.10) < 0.06
        assert abs(f.beta - 0.87) < 0.08
        assert abs(f.persistence - 0.97) < 0.03
        assert f.converged
        assert f.is_stationary
        assert f.residuals_are_clean
        assert f.arch_before_p < 0.001
        assert f.half_life_days == pytest.approx(math.log(0.5) / math.log(f.persistence))
        assert f.aic == pytest.approx(-2 * f.log_likelihood + 2 * (4 if f.nu is None else 5))
    assert one(fits[2]).nu > 10  # the shocks are normal


def test_slopes_are_derivatives():
    x = garch_returns(600) * 100
    for p in ((0.02, 0.03, 0.1, 0.85, 6.0), (0.1, 0.5, 0.2, 0.3), (-0.2, 0.01, 0.01, 0.98, 2.3)):
        for k, slope in enumerate(fit.garch_slope(x, p)):
            h = 1e-5 * max(abs(p[k]), 1e-2)
            up, down = ([*p[:k], p[k] + d, *p[k + 1 :]] for d in (h, -h))
            assert slope == pytest.approx((fit.garch_likelihood(x, tuple(up)) - fit.garch_likelihood(x, tuple(down))) / (2 * h), rel=1e-5, abs=1e-4)


def test_sums_by_doubling():
    u = np.random.default_rng(1).normal(size=300)
    for beta in (0.0, 0.3, 0.99, 1.0):
        y, want = 0.0, []
        for v in u:
            y = v + beta * y
            want.append(y)
        assert fit.decayed_sums(u, beta) == pytest.approx(np.array(want), rel=1e-9, abs=1e-12)


def test_short_series_have_a_reason(fits):
    f = one(fits[1], series_id="S")
    assert (f.omega, f.reason) == (None, f"fewer than {S.GARCH_MIN} returns")


def test_a_fit_is_a_maximum(fits):
    x = garch_returns() * 100
    f = one(fits[1], series_id="G")
    best = (f.mu, f.omega, f.alpha, f.beta)
    for k in range(4):
        for step in (0.97, 1.03):
            other = list(best)
            other[k] *= step
            assert fit.garch_likelihood(x, tuple(other)) <= f.log_likelihood + 1e-4


def test_forecasts_move_to_the_long_run(fits):
    f = one(fits[1], series_id="G")
    path = ordered(fit.forecast_path(fits[1], 400), "daily_volatility", "day")
    v = f.last_variance
    for h in range(3):
        v = f.omega + f.persistence * v
        assert path[h] == pytest.approx(math.sqrt(v) / 100)
    assert path[-1] * 252**0.5 == pytest.approx(f.long_run_annualised, rel=1e-3)
    c = one(fit.conditional_var(fits[1], 0.95, 10))
    assert c.conditional_sigma == pytest.approx(math.sqrt(sum(p * p for p in path[:10])))
    t = one(fit.conditional_var(fits[2], 0.99))
    assert 0 < t.var_return < 0.2
    with pytest.raises(ValueError):
        fit.forecast_path(fits[1], 0)


def test_unit_persistence_has_no_long_run(spark):
    df = spark.createDataFrame([("A", 0.1, 0.2, 0.8, 1.0), ("B", 0.1, 0.1, 0.896, 1.0)], "series_id string, omega double, alpha double, beta double, last_variance double")
    d = {r.series_id: r for r in fit.derived(df).collect()}
    assert (d["A"].is_stationary, d["A"].half_life_days, d["A"].long_run_annualised) == (False, math.inf, None)
    assert (d["B"].is_stationary, d["B"].long_run_is_reliable) == (True, False)


def test_series_of_a_fit(fits):
    s = fit.garch_series(fits[0], "normal")
    assert s.count() == 2000
    f = one(fits[1], series_id="G")
    assert ordered(s, "conditional_volatility")[-1] ** 2 == pytest.approx(f.last_variance, rel=1e-6)


def test_rolling_conditional_var(spark):
    x = garch_returns(640)
    got = ordered(fit.rolling_conditional_var(table(spark, {"A": x}), 0.95, 100, 500, "normal"), "var")
    assert len(got) == 140
    f = fit.fit_garch_array(x[:500] * 100, "normal")
    v, mean, z = f["sigma2"][-1], (x[:500] * 100).mean(), -1.6448536269514722
    assert got[0] == pytest.approx(1 - math.exp(z * math.sqrt(f["omega"] + (f["alpha"] + f["beta"]) * v) / 100))
    v = f["omega"] + f["alpha"] * (x[500] * 100 - mean) ** 2 + f["beta"] * v
    assert got[1] == pytest.approx(1 - math.exp(z * math.sqrt(f["omega"] + (f["alpha"] + f["beta"]) * v) / 100))
    y = x.copy()
    y[620:] = 0.3  # nothing before sees it
    again = ordered(fit.rolling_conditional_var(table(spark, {"A": y}), 0.95, 100, 500, "normal"), "var")
    assert again[:120] == pytest.approx(got[:120])


def test_calendar(spark):
    r = spark.createDataFrame([("a", "2024-02-29"), ("a", "2024-01-01"), ("b", "2023-12-29")], "series_id string, d string").withColumn("d", F.col("d").cast("date"))
    got = [(x.series_id, x.day, x.d.isoformat()) for x in fit.business_days(r, 3).orderBy("series_id", "day").collect()]
    assert got == [("a", 1, "2024-03-01"), ("a", 2, "2024-03-04"), ("a", 3, "2024-03-05"), ("b", 1, "2024-01-01"), ("b", 2, "2024-01-02"), ("b", 3, "2024-01-03")]


def test_the_rolling_query_keeps_the_defaults(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "line_returns", lambda spark, folder: "returns")
    monkeypatch.setattr(fit, "rolling_conditional_var", lambda *a, **k: asked.append((a, k)))
    queries.rolling_conditional_var(None, None)
    assert asked == [(("returns",), {})]
