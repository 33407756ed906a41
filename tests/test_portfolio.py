import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import portfolio, tail

from .helpers import normal_returns, one, table


def setup(spark, n=300, w=(0.5, 0.3, 0.2)):
    a = normal_returns(n, 1)
    named = {"A": a, "B": 0.8 * a + 0.6 * normal_returns(n, 2), "C": -0.3 * a + normal_returns(n, 3)}
    weights = spark.createDataFrame([("P", k, float(x)) for k, x in zip("ABC", w, strict=True)], "portfolio_id string, series_id string, w double")
    return np.exp(np.array(list(named.values()))) - 1, table(spark, named), weights


def test_decomposition_against_numpy(spark):
    x, r, weights = setup(spark)
    w = np.array([0.5, 0.3, 0.2])
    cov = np.cov(x) * 252
    vol = np.sqrt(w @ cov @ w)
    each = {c.series_id: c for c in portfolio.contributions(portfolio.covariance_pairs(portfolio.aligned(r, weights))).collect()}
    marginal = cov @ w / vol
    for k, name in enumerate("ABC"):
        c = each[name]
        assert (c.marginal, c.contribution, c.share, c.own_volatility) == pytest.approx((marginal[k], w[k] * marginal[k], w[k] * marginal[k] / vol, np.sqrt(cov[k, k])))
    assert sum(c.contribution for c in each.values()) == pytest.approx(vol, rel=1e-10)  # Euler


def test_whole_analysis(spark):
    x, r, weights = setup(spark)
    w = np.array([0.5, 0.3, 0.2])
    p = one(portfolio.analyse(r, weights, 0.02))
    d = w @ x
    e = d - 0.02 / 252
    assert p.annualised_return == pytest.approx(d.mean() * 252)
    assert p.sharpe == pytest.approx(e.mean() / d.std(ddof=1) * 252**0.5)
    assert p.sortino == pytest.approx(e.mean() / np.sqrt((np.minimum(e, 0) ** 2).mean()) * 252**0.5)
    curve = np.cumprod(1 + d)
    assert p.max_drawdown == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())
    assert p.effective_holdings == pytest.approx(1 / (w**2).sum())
    assert (p.heaviest, len(p.members), p.n_observations) == ("A", 3, 300)
    assert p.risk_reduction > 0


def test_only_common_days_and_enough_of_them(spark):
    named = {"A": normal_returns(100, 1), "B": [None] * 30 + list(normal_returns(70, 2)), "C": normal_returns(50, 3)}
    weights = spark.createDataFrame([("P", "A", 1.0), ("P", "B", 1.0), ("Q", "A", 1.0), ("Q", "C", 1.0), ("R", "A", 1.0)], "portfolio_id string, series_id string, w double")
    panel = portfolio.aligned(table(spark, named), weights)
    assert {(r.portfolio_id, r.n) for r in panel.groupBy("portfolio_id").agg(F.countDistinct("d").alias("n")).collect()} == {("P", 70)}


def test_weights(spark):
    w = spark.createDataFrame([("P", "A", 3.0), ("P", "B", -1.0)], "portfolio_id string, series_id string, w double")
    assert {r.series_id: r.w for r in portfolio.normalised(w).collect()} == {"A": 1.5, "B": -0.5}
    zero = spark.createDataFrame([("P", "A", 1.0), ("P", "B", -1.0)], "portfolio_id string, series_id string, w double")
    with pytest.raises(Exception, match="sum to zero"):
        portfolio.normalised(zero).collect()
    assert {r.w for r in portfolio.equal_weights(w.drop("w")).collect()} == {0.5}
    assert portfolio.parse_weights("50%, 0.5", ["a", "b"]) == [("a", 0.5), ("b", 0.5)]
    assert portfolio.parse_weights(" ", ["a", "b"]) == [("a", 0.5), ("b", 0.5)]
    with pytest.raises(ValueError, match="1 weights for 2"):
        portfolio.parse_weights("1", ["a", "b"])
    r = table(spark, {"A": [0.1, 0.2]})
    assert [x.series_id for x in portfolio.missing_members(w, r).collect()] == ["B"]


def test_minimum_variance_beats_equal_weights(spark):
    x, r, weights = setup(spark)
    pairs = portfolio.covariance_pairs(portfolio.aligned(r, weights))
    got = {m.series_id: m.w for m in portfolio.minimum_variance(pairs).collect()}
    w = np.array([got[k] for k in "ABC"])
    cov = np.cov(x) * 252
    want = np.linalg.pinv(cov) @ np.ones(3)
    assert w == pytest.approx(want / want.sum())
    assert w @ cov @ w < np.full(3, 1 / 3) @ cov @ np.full(3, 1 / 3)


def test_same_bets_and_hedges(spark):
    a = normal_returns(200, 1)
    named = {"A": a, "B": a + normal_returns(200, 2, 0, 0.0005), "C": -a + normal_returns(200, 3, 0, 0.001)}
    weights = spark.createDataFrame([("P", "A", 0.6), ("P", "B", 0.2), ("P", "C", 0.2)], "portfolio_id string, series_id string, w double")
    p = one(portfolio.analyse(table(spark, named), weights))
    assert [(b.i, b.j) for b in p.same_bets] == [("A", "B")]
    assert "members that lower the risk" in p.notes
    assert "members that are nearly the same bet" in p.notes


def test_own_series_feeds_single_series_operators(spark):
    x, r, weights = setup(spark, w=(2.0, 1.0, 1.0))
    s = portfolio.log_series(portfolio.aligned(r, weights))
    want = np.log1p(np.array([0.5, 0.25, 0.25]) @ x)
    assert one(tail.historical_var(s)).var_return == pytest.approx(1 - np.exp(np.quantile(want, 0.05)))
    var = tail.historical_var(r)
    total = one(portfolio.component_var_sum(var, weights)).component_var
    assert total > one(tail.historical_var(s)).var_return
