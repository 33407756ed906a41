import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.functions.columns import normal_quantile
from tailframe.operators import simulate, tail

from .helpers import fat_returns, normal_returns, one, ordered, table


@pytest.mark.parametrize("confidence", [0.5, 1.0, 0.2])
def test_guards(spark, confidence):
    t = table(spark, {"A": [0.1, 0.2]})
    for f in (tail.historical_var, tail.historical_es, tail.parametric_var, tail.rolling_historical_var):
        with pytest.raises(ValueError, match="confidence"):
            f(t, confidence=confidence)
    with pytest.raises(ValueError, match="horizon"):
        tail.historical_var(t, 0.95, 0)


def test_historical_var_by_hand(spark):
    x = normal_returns(1000)
    v = one(tail.historical_var(table(spark, {"A": x}), 0.99, 10, 1e6))
    q = np.quantile(x, 1 - 0.99)
    assert v.var_return == pytest.approx(1 - math.exp(q * 10**0.5))
    assert v.var_value == pytest.approx(1e6 * v.var_return)
    assert v.tail_observations == (x <= q).sum()
    assert v.worst_observed_loss == pytest.approx(1 - math.exp(x.min() * 10**0.5))
    assert not v.at_the_edge


def test_ties_raise_the_tail_count_but_not_the_tail_rank(spark):
    v = [-1.0] * 400 + [0.02] * 9600
    t = table(spark, {"A": v})
    assert one(tail.historical_var(t, 0.95)).tail_observations == 10_000  # the quantile is 0.02
    es = one(tail.historical_es(t, 0.95))
    assert es.tail_observations == 500
    assert es.es_return == pytest.approx(1 - math.exp((400 * -1.0 + 100 * 0.02) / 500))


@pytest.mark.parametrize(("n", "confidence", "k"), [(1000, 0.95, 50), (250, 0.99, 3), (10, 0.99, 1), (2000, 0.975, 50)])
def test_tail_counts_are_free_of_float_noise(spark, n, confidence, k):
    assert spark.range(1).select(tail.tail_count(F.lit(n), confidence)).first()[0] == k


def test_short_and_empty_series(spark):
    t = table(spark, {"A": [0.01], "B": [None, None]})
    v = one(tail.historical_var(t))
    assert (v.series_id, v.var_return, v.warnings) == ("A", None, ["fewer than two returns"])
    assert tail.historical_es(t).count() == 0
    assert tail.parametric_var(t).count() == 0


def test_es_is_beyond_var_and_grows_with_confidence(spark):
    t = table(spark, {"N": normal_returns(), "F": fat_returns()})
    rows = {(r.series_id, c): r for c in (0.95, 0.99) for r in tail.historical_es(t, c).collect()}
    assert all(r.es_return >= r.var_return for r in rows.values())
    assert rows["F", 0.99].es_return > rows["F", 0.95].es_return
    assert rows["F", 0.99].tail_severity > rows["N", 0.99].tail_severity


def test_distribution_shape(spark):
    x = fat_returns()
    f = one(tail.fit_distribution(table(spark, {"A": x})))
    z = (x - x.mean()) / x.std()
    s, k = (z**3).mean(), (z**4).mean() - 3
    assert (f.skewness, f.excess_kurtosis, f.jarque_bera) == pytest.approx((s, k, 2000 / 6 * (s * s + k * k / 4)))
    assert (f.is_normal, f.has_fat_tails) == (False, True)
    assert one(tail.fit_distribution(table(spark, {"A": normal_returns()}))).is_normal
    assert one(tail.fit_distribution(table(spark, {"A": [0.1] * 3}))).skewness is None


def test_normal_var_and_es(spark):
    x = normal_returns()
    p = one(tail.parametric_var(table(spark, {"A": x}), 0.99, 5))
    mu, sd, z = x.mean() * 5, x.std(ddof=1) * 5**0.5, normal_quantile(1 - 0.99)
    assert p.var_return == pytest.approx(1 - math.exp(mu + z * sd))
    # Against a large simulation.
    sim = np.sort(np.random.default_rng(1).normal(mu, sd, 2_000_000))[:20_000]
    assert p.es_return == pytest.approx(1 - math.exp(sim.mean()), rel=0.02)


def test_student_t_var_is_beyond_normal_at_the_far_tail(spark):
    t = table(spark, {"A": fat_returns()})
    n, s = (one(tail.parametric_var(t, 0.99, distribution=d)) for d in ("normal", "t"))
    assert 2.5 <= s.dof < 4
    assert s.var_return > n.var_return * 0.95
    assert s.es_return > n.es_return
    assert one(tail.normal_vs_historical(t, 0.99)).gap > 0
    with pytest.raises(ValueError, match="distribution"):
        tail.parametric_var(t, distribution="other")


def test_rolling_var_has_no_look_ahead(spark):
    x = normal_returns(300)
    a = ordered(tail.rolling_historical_var(table(spark, {"A": x}), 100), "var")
    y = x.copy()
    y[200:] = -0.5
    b = ordered(tail.rolling_historical_var(table(spark, {"A": y}), 100), "var")
    assert a[:99] == [None] * 99
    assert a[99:200] == b[99:200]
    assert a[150] == pytest.approx(1 - math.exp(np.quantile(x[51:151], 0.05)))  # the day itself is inside
    assert a[250] != b[250]


def test_breaches(spark):
    r = table(spark, {"A": [0.01, -0.10, None, -0.02]})
    v = table(spark, {"A": [0.05, 0.05, 0.05, None]}, "var")
    s = tail.breaches(r, v)
    assert ordered(s, "is_breach") == [0, 1]
    assert [x.excess for x in s.where("is_breach = 1").collect()] == pytest.approx([1 - math.exp(-0.10) - 0.05])
    assert one(tail.breach_rate(s)).observed_rate == 0.5
    side_by_side = r.join(v, ["series_id", "d"])
    assert sorted(tail.mark_breaches(side_by_side).select(*s.columns).collect()) == sorted(s.collect())


def test_histogram_counts_everything(spark):
    t = table(spark, {"A": normal_returns(500), "B": [0.01, 0.01]})
    h = tail.return_histogram(t).collect()
    assert sum(r.n for r in h if r.series_id == "A") == 500
    assert {r.bin for r in h if r.series_id == "B"} == {0}
    assert max(r.bin for r in h) == 119


def test_subadditivity():
    d = simulate.subadditivity_demo()
    assert not d["var_is_subadditive"]
    assert d["es_is_subadditive"]
    assert (d["var_a"], round(d["var_sum"], 2)) == (-0.02, 0.49)


def test_no_task_holds_a_book(spark, monkeypatch):
    """Books of any length: values are counted, not ranked or gathered; a book without a name is a book."""
    from tailframe.operators import order

    monkeypatch.setattr(order, "ENOUGH", 5)
    x = np.random.default_rng(8).normal(size=(2, 400))
    rows = [("m" if k < 250 else None, float(a), float(b)) for k, (a, b) in enumerate(x.T)]
    out = simulate.subadditivity(spark.createDataFrame(rows, "book string, a double, b double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "percentile" not in plan
    got = {r.book: r for r in out.collect()}
    for book, part in (("m", x[:, :250]), (None, x[:, 250:])):
        for name, v in (("a", part[0]), ("b", part[1]), ("sum", part.mean(axis=0))):
            assert got[book][f"var_{name}"] == pytest.approx(-np.quantile(v, 0.05), rel=1e-9)
            k = math.ceil(round(len(v) * 0.05, 9))
            assert got[book][f"es_{name}"] == pytest.approx(-np.sort(v)[:k].mean(), rel=1e-9)


def test_subadditivity_of_books(spark):
    """4% each, independent: 4 of 100 scenarios lose a, 4 of 100 of each of those b."""
    lost = lambda on: -1.0 if on else 0.02
    rows = [("x", lost(i % 25 == 0), lost((i // 25) % 25 == 0)) for i in range(2500)] + [("one", -0.5, 0.1)]
    got = {r.book: r for r in simulate.subadditivity(spark.createDataFrame(rows, "book string, a double, b double")).collect()}
    assert (got["x"].var_is_subadditive, got["x"].es_is_subadditive) == (False, True)
    assert (got["x"].var_a, round(got["x"].var_sum, 2)) == (-0.02, 0.49)
    assert (got["one"].es_a, round(got["one"].es_sum, 9)) == (0.5, 0.2)
