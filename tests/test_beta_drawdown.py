import numpy as np
import pytest

from tailframe.operators import beta, drawdown

from .helpers import business_days, normal_returns, one, ordered, prices, table


def pair(spark, n=800, b=1.8, noise=0.004):
    bench = normal_returns(n, 1)
    asset = b * bench + normal_returns(n, 2, 0, noise)
    a = table(spark, {"A": asset})
    m = table(spark, {"M": bench}).select("d", "r", "series_id")
    return asset, bench, beta.align(a, m)


def test_regression_against_numpy(spark):
    asset, bench, al = pair(spark)
    r = one(beta.regression(al))
    slope, intercept = np.polyfit(bench, asset, 1)
    rest = asset - slope * bench - intercept
    se = np.sqrt((rest**2).sum() / (len(asset) - 2) / ((bench - bench.mean()) ** 2).sum())
    assert (r.beta_regression, r.beta_moments, r.alpha) == pytest.approx((slope, slope, intercept), rel=1e-8)
    assert (r.standard_error, r.t_statistic) == pytest.approx((se, slope / se), rel=1e-8)
    assert r.r_squared == pytest.approx(np.corrcoef(asset, bench)[0, 1] ** 2)
    assert abs(r.beta_regression - 1.8) < 0.1
    assert (r.confidence, r.is_significant, r.routes_agree) == ("high", True, True)
    assert r.p_value < 1e-10


def test_only_common_days_count(spark):
    a = table(spark, {"A": [0.1, None, 0.3, 0.4]})
    m = table(spark, {"M": [0.1, 0.2, float("nan"), 0.4, 0.5]})
    assert beta.align(a, m).count() == 2


def test_flat_benchmark_and_short_series_give_nulls(spark):
    a = table(spark, {"A": [0.1, 0.2, 0.3]})
    r = one(beta.regression(beta.align(a, table(spark, {"M": [0.1, 0.1, 0.1]}))))
    assert (r.beta_regression, r.r_squared, r.p_value, r.confidence) == (None, None, None, "low")
    r = one(beta.regression(beta.align(a, table(spark, {"M": [0.1]}))))
    assert (r.beta_regression, r.n_observations) == (None, 1)


def test_rolling_beta(spark):
    asset, bench, al = pair(spark, 120)
    got = ordered(beta.rolling_beta(al, 60), "rolling_beta")
    assert got[:59] == [None] * 59
    k = 90
    assert got[k] == pytest.approx(np.cov(asset[k - 59 : k + 1], bench[k - 59 : k + 1])[0, 1] / np.var(bench[k - 59 : k + 1], ddof=1))


def test_drawdown_series_and_summary(spark):
    p = prices(spark, {"A": [100, 120, 90, 108, 60, 120, 119], "B": [1, 2, 3]})
    assert ordered(drawdown.drawdowns(p.where("series_id = 'A'")), "dd") == pytest.approx([0, 0, -0.25, -0.1, -0.5, 0, -1 / 120])
    s = one(drawdown.drawdown_summary(p), series_id="A")
    assert (s.max_drawdown, s.max_drawdown_date, s.current_duration_days, s.is_in_drawdown) == (-0.5, business_days(7)[4], 1, True)
    s = one(drawdown.drawdown_summary(p), series_id="B")
    assert (s.current_drawdown, s.current_duration_days, s.is_in_drawdown) == (0.0, 0, False)


def test_episodes(spark):
    d = business_days(9)
    p = prices(spark, {"A": [100, 80, 80, 100, 100, 95, 110, 50, 70]})
    got = sorted((r.peak_date, r.trough_date, round(r.depth, 6), r.days_to_trough, r.recovery_date, r.days_to_recovery) for r in drawdown.drawdown_episodes(p).collect())
    # The first of tied troughs, the last of tied peaks, and an open episode without recovery.
    assert got == [(d[0], d[1], -0.2, 1, d[3], 2), (d[6], d[7], round(-60 / 110, 6), 1, None, None)]
    assert [r.peak_date for r in drawdown.drawdown_episodes(p, 0.04).collect() if abs(r.depth + 0.05) < 1e-9] == [d[4]]
    assert drawdown.drawdown_episodes(p, 0.6).count() == 0


def test_first_day_loss_of_a_curve_is_invisible(spark):
    t = table(spark, {"P": [-0.5, 0.0, 0.1]})
    assert one(drawdown.curve_drawdown(t)).max_drawdown == 0.0
