import math

import numpy as np
import pytest

from tailframe import queries
from tailframe.operators import simulate, tail
from tailframe.plans import settings as S

from .helpers import fat_returns, normal_returns, one, table


def test_bootstrap_interval_is_that_of_one_draw():
    x = normal_returns(500)
    low, high = simulate.bootstrap_interval(x, 0.95, samples=300)
    draws = np.random.default_rng(S.SEED).choice(x, size=(300, 500), replace=True)
    want = np.percentile(-(np.exp(np.quantile(draws, 1 - 0.95, axis=1)) - 1), [2.5, 97.5])
    assert (low, high) == pytest.approx(tuple(want))
    monkey = 4_000_000 // 500
    assert monkey > 300  # one block here; below, many
    x = normal_returns(40_000)
    blocks = simulate.bootstrap_interval(x, 0.95, samples=250)
    draws = np.random.default_rng(S.SEED).choice(x, size=(250, 40_000), replace=True)
    want = np.percentile(-(np.exp(np.quantile(draws, 1 - 0.95, axis=1)) - 1), [2.5, 97.5])
    assert blocks == pytest.approx(tuple(want))


def test_interval_holds_the_estimate_and_scales(spark):
    t = table(spark, {"A": normal_returns()})
    v, ci = one(tail.historical_var(t)), one(simulate.var_intervals(t, samples=400))
    assert ci.ci_low < v.var_return < ci.ci_high
    ten = one(simulate.var_intervals(t, days=10, samples=400))
    assert ten.ci_low == pytest.approx(1 - math.exp(math.log1p(-ci.ci_low) * 10**0.5))


def test_monte_carlo_repeats_with_its_seed(spark):
    t = table(spark, {"A": normal_returns(), "B": fat_returns()})
    a, b, c = (sorted(map(tuple, simulate.monte_carlo(t, seed=s).collect())) for s in (1, 1, 2))
    assert a == b
    assert a != c


def test_draws_agree_with_their_distributions(spark):
    x = normal_returns()
    t = table(spark, {"A": x})
    h = one(tail.historical_var(t)).var_return
    boot = one(simulate.monte_carlo(t, paths=50_000))
    assert boot.var_return == pytest.approx(h, rel=0.03)
    assert not boot.exceeds_history  # one day of resampling is never worse than the worst day
    normal = one(simulate.monte_carlo(t, paths=50_000, draw="normal"))
    assert normal.var_return == pytest.approx(one(tail.parametric_var(t)).var_return, rel=0.03)
    assert boot.standard_error < 0.002
    es = one(tail.historical_es(t)).es_return
    assert boot.es_return == pytest.approx(es, rel=0.1)
    ten = one(simulate.monte_carlo(t, days=10))
    assert ten.worst_observed_loss == pytest.approx(1 - math.exp(x.min() * 10))  # by the horizon, not its root


def test_t_draws_have_the_sample_spread():
    x = fat_returns()
    sim = simulate.draw_paths(x, 400_000, 1, "t", np.random.default_rng(1), 5.0)
    assert sim.std() == pytest.approx(x.std(ddof=1), rel=0.02)
    with pytest.raises(ValueError, match="degrees"):
        simulate.draw_paths(x, 10, 1, "t", np.random.default_rng(1))


def test_guards(spark):
    t = table(spark, {"A": normal_returns(50)})
    for bad in ({"paths": 10}, {"draw": "other"}, {"days": 0}, {"confidence": 0.4}):
        with pytest.raises(ValueError):
            simulate.monte_carlo(t, **bad)
    with pytest.raises(ValueError):
        simulate.hashed_paths(t, draw="other")


def test_convergence_steps(spark):
    c = sorted(simulate.convergence(table(spark, {"A": normal_returns()}), sizes=(500, 1000, 2000)).collect(), key=lambda r: r.paths)
    assert [r.paths for r in c] == [500, 1000, 2000]
    assert c[0].step is None or math.isnan(c[0].step)
    assert c[1].step == pytest.approx(abs(c[1].var_return - c[0].var_return))


def test_hashed_engine(spark):
    x = normal_returns()
    t = table(spark, {"A": x, "B": fat_returns()})
    a = sorted(map(tuple, simulate.hashed_paths(t, 200, 3).collect()))
    b = sorted(map(tuple, simulate.hashed_paths(t.repartition(7), 200, 3).collect()))
    assert a == b
    h = one(simulate.hashed_monte_carlo(t, paths=40_000), series_id="A")
    assert h.var_return == pytest.approx(one(tail.historical_var(t), series_id="A").var_return, rel=0.04)
    n = one(simulate.hashed_monte_carlo(t, paths=40_000, draw="normal"), series_id="A")
    assert n.var_return == pytest.approx(one(tail.parametric_var(t), series_id="A").var_return, rel=0.04)


def test_hashed_t_draws(spark):
    t = table(spark, {"A": fat_returns(), "B": normal_returns(n=7)})
    paths = simulate.hashed_paths(t, 40_000, draw="t")
    assert {r.series_id for r in paths.select("series_id").distinct().collect()} == {"A"}
    h = one(simulate.hashed_monte_carlo(t, paths=40_000, draw="t"), series_id="A")
    assert h.var_return == pytest.approx(one(tail.parametric_var(t, distribution="t"), series_id="A").var_return, rel=0.05)


def test_five_methods(spark):
    c = simulate.compare_methods(table(spark, {"A": fat_returns()}), 0.99, paths=5000).collect()
    assert {r.method for r in c} == {"historical", "parametric-normal", "parametric-t", "monte-carlo-bootstrap", "monte-carlo-t"}
    by = {r.method: r for r in c}
    assert by["historical"].var_vs_historical == 0
    assert by["parametric-normal"].es < by["historical"].es
    assert all(r.es >= r.var for r in c)


def test_the_bootstrap_query_keeps_the_defaults(monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "line_returns", lambda spark, folder: "returns")
    monkeypatch.setattr(simulate, "var_intervals", lambda *a, **k: asked.append((a, k)))
    queries.bootstrap_interval(None, None)
    assert asked == [(("returns",), {})]
