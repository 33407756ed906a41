import math

import numpy as np
import pytest

from tailframe.operators import returns, volatility

from .helpers import business_days, normal_returns, one, ordered, prices, table


def test_both_kinds_of_returns(spark):
    p = prices(spark, {"A": [100.0, 110.0, 99.0], "B": [5.0]})
    assert ordered(returns.simple_returns(p), "r") == pytest.approx([0.10, -0.10])
    assert ordered(returns.log_returns(p), "r") == pytest.approx([math.log(1.1), math.log(0.9)])
    with pytest.raises(ValueError, match="method"):
        returns.compute_returns(p, "other")


def test_gaps_drop_both_sides(spark):
    p = prices(spark, {"A": [100.0, None, 121.0, 133.1]})
    assert ordered(returns.log_returns(p), "r") == pytest.approx([math.log(1.1)])
    assert ordered(returns.simple_returns(p), "r") == pytest.approx([0.1])


def test_cumulation_round_trips(spark):
    levels = 100 * np.exp(np.cumsum(normal_returns(200, 1)))
    p = prices(spark, {"A": levels})
    for method in ("log", "simple"):
        r = returns.compute_returns(p, method)
        total = one(returns.cumulative_return(r, method)).cumulative_return
        assert total == pytest.approx(math.log(levels[-1] / levels[0]) if method == "log" else levels[-1] / levels[0] - 1)
        assert ordered(returns.price_index(r, method, float(levels[0])), "level") == pytest.approx(list(levels[1:]))


def test_horizons_and_last_window(spark):
    x = normal_returns(300, 2)
    t = table(spark, {"A": x, "B": x[:1]})
    v = one(volatility.historical_volatility(t, 60), series_id="A")
    sd = np.std(x[-60:], ddof=1)
    assert (v.daily, v.weekly, v.monthly, v.annualised) == pytest.approx((sd, sd * 5**0.5, sd * 21**0.5, sd * 252**0.5))
    assert (v.window, v.n_observations) == (60, 60)
    assert one(volatility.historical_volatility(t), series_id="B").daily is None


def test_rolling_needs_full_windows(spark):
    x = normal_returns(100, 3)
    got = ordered(volatility.rolling_volatility(table(spark, {"A": x}), 20), "vol")
    assert got[:19] == [None] * 19
    assert got[19:] == pytest.approx([np.std(x[k - 19 : k + 1], ddof=1) * 252**0.5 for k in range(19, 100)])


@pytest.mark.parametrize(("current", "average", "word"), [(1.75, 1.0, "elevated"), (1.74, 1.0, "normal"), (0.6, 1.0, "subdued"), (0.61, 1.0, "normal"), (1.0, 0.0, "unknown"), (None, 1.0, "unknown"), (float("nan"), 1.0, "unknown")])
def test_regime_bounds(spark, current, average, word):
    from tailframe.functions.columns import volatility_regime

    df = spark.createDataFrame([(current, average)], "c double, a double")
    assert df.select(volatility_regime("c", "a")).first()[0] == word


def test_spike_episodes(spark):
    v = [1.0, 1.0, 2.0, 3.0, 1.0, 1.0, 2.0, 1.0, 1.0, 4.0]
    t = table(spark, {"A": v, "B": [1.0] * 10, "C": [None] * 5}, "vol")
    days = business_days(10)
    got = sorted((r.start_date, r.end_date, r.peak_volatility, r.duration_days) for r in volatility.spike_episodes(t).collect())
    assert got == [(days[2], days[3], 3.0, 2), (days[6], days[6], 2.0, 1), (days[9], days[9], 4.0, 1)]
    assert volatility.spike_episodes(t.where("series_id = 'C'")).columns == ["series_id", "start_date", "end_date", "peak_volatility", "duration_days"]
    # At the limit itself there is no spike.
    assert volatility.spike_episodes(table(spark, {"A": [1.0, 1.0, 1.75]}, "vol")).count() == 0
