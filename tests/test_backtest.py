import math

import numpy as np
import pytest

from tailframe.operators import backtest, tail

from .helpers import normal_returns, one, table


def scored(spark, flags, name="A"):
    r = [math.log(1 - 0.05) if f else 0.001 for f in flags]
    return tail.breaches(table(spark, {name: r}), table(spark, {name: [0.03] * len(r)}, "var"))


def brute_kupiec(n, x, p):
    log = lambda k, q: k * math.log(q) if k else 0.0
    return -2 * (log(x, p) + log(n - x, 1 - p) - log(x, x / n) - log(n - x, 1 - x / n))


@pytest.mark.parametrize("x", [0, 1, 20, 50, 400])
def test_kupiec(spark, x):
    flags = [k < x for k in range(400)]
    r = one(backtest.backtest(scored(spark, flags)))
    assert r.kupiec_statistic == pytest.approx(brute_kupiec(400, x, 1 - 0.95), abs=1e-9)
    assert r.kupiec_p == pytest.approx(math.erfc(math.sqrt(max(r.kupiec_statistic, 0.0) / 2)))
    assert r.passes_coverage == (r.kupiec_p >= 0.05)


def test_spread_and_clustered_breaches(spark):
    spread = [k % 20 == 10 for k in range(1000)]
    cluster = [400 <= k < 450 for k in range(1000)]
    a, b = (one(backtest.backtest(scored(spark, f))) for f in (spread, cluster))
    assert (a.passes_coverage, a.max_consecutive) == (True, 1)
    assert (b.passes_coverage, b.passes_independence, b.max_consecutive, b.verdict) == (True, False, 50, "rejected on clustering")
    n00, n01, n10, n11 = 948, 1, 1, 49
    pi = 50 / 999
    null = (n00 + n10) * math.log(1 - pi) + (n01 + n11) * math.log(pi)
    alt = n00 * math.log(n00 / 949) + n01 * math.log(n01 / 949) + n10 * math.log(n10 / 50) + n11 * math.log(n11 / 50)
    assert b.christoffersen_statistic == pytest.approx(-2 * (null - alt))
    assert b.joint_p == pytest.approx(math.exp(-(b.kupiec_statistic + b.christoffersen_statistic) / 2))


def test_unidentified_independence_is_not_rejected(spark):
    for flags in ([False] * 600, [True] * 20, [False] * 599 + [True]):
        r = one(backtest.backtest(scored(spark, flags)))
        assert (r.christoffersen_statistic, r.christoffersen_p) == (0.0, 1.0)
    assert "no breaches: too conservative" in one(backtest.backtest(scored(spark, [False] * 600))).warnings
    assert "few observations: low power" in one(backtest.backtest(scored(spark, [True] * 20))).warnings


def test_statistics_alone_give_the_same_passes(spark):
    r = np.random.default_rng(4)
    for _ in range(4):
        s = scored(spark, list(r.random(700) < r.uniform(0.02, 0.09)))
        a, b = one(backtest.backtest(s)), one(backtest.backtest(s, p_values=False))
        assert (a.passes_coverage, a.passes_independence, a.passes_joint) == (b.passes_coverage, b.passes_independence, b.passes_joint)
    with pytest.raises(ValueError, match="alpha"):
        backtest.backtest(s, alpha=0.01, p_values=False)


def test_models_side_by_side(spark):
    r = table(spark, {"A": normal_returns(900)})
    by = ("series_id", "model")
    both = None
    for model, window in (("long", 500), ("short", 100)):
        v = tail.rolling_historical_var(r, window).selectExpr(f"'{model}' AS model", "*")
        both = v if both is None else both.unionByName(v)
    t = backtest.compare(tail.breaches(both.select(*by, "d", "r"), both.select(*by, "d", "var"), by)).collect()
    assert {x.model for x in t} == {"long", "short"}
    assert all(x.coverage in ("pass", "FAIL") for x in t)
    long = next(x for x in t if x.model == "long")
    assert long.expected == round(401 * 0.05, 1)


@pytest.mark.parametrize(("n", "days", "zone"), [(4, 250, "green"), (5, 250, "yellow"), (9, 250, "yellow"), (10, 250, "red"), (8, 500, "green"), (9, 500, "yellow"), (19, 500, "red")])
def test_zones(spark, n, days, zone):
    r = one(backtest.basel(scored(spark, [k < n for k in range(days)]), None))
    assert (r.zone, r.n_breaches, r.exact_window) == (zone, n, days == 250)


def test_zone_of_the_last_days(spark):
    r = one(backtest.basel(scored(spark, [k < 50 for k in range(600)])))
    assert (r.zone, r.n_days, r.n_breaches) == ("green", 250, 0)
