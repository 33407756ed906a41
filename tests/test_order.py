import numpy as np
import pytest

from tailframe.operators import order, tail

from .helpers import fat_returns, normal_returns, one, table


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(order, "BINS", 8)
    monkeypatch.setattr(order, "ENOUGH", 5)


def test_every_rank(spark, tiny):
    r = np.random.default_rng(1)
    named = {"N": r.normal(size=60), "T": r.integers(0, 4, 60).astype(float), "G": np.concatenate([np.zeros(30), [1e300], -np.full(29, 1e-300)]), "H": np.array([-1.7e308, 1.7e308, 0.0, 1.0])}
    t = table(spark, named)
    ranks = spark.createDataFrame([(k, i) for k, v in named.items() for i in range(len(v))] + [("N", 60), ("N", -1)], "series_id string, rank long")
    got = {(x.series_id, x.rank): x.x for x in order.order_statistics(t, ranks).collect()}
    assert got == {(k, i): float(x) for k, v in named.items() for i, x in enumerate(np.sort(v))}


@pytest.mark.parametrize("p", [0.0, 0.01, 0.05, 0.5, 1.0])
def test_quantiles(spark, tiny, p):
    x = normal_returns(777)
    got = {r.series_id: r.q for r in order.quantile(table(spark, {"A": x, "B": [1.0], "C": [None]}), p).collect()}
    assert got == {"A": pytest.approx(np.quantile(x, p), rel=1e-12), "B": 1.0}


def test_long_series_have_the_same_tail(spark, tiny):
    t = table(spark, {"A": fat_returns(1500), "B": [-1.0] * 40 + [0.02] * 960, "C": [0.1]})
    got = {r.series_id: r for r in order.long_tail(t, 0.95, 5).collect()}
    assert set(got) == {"A", "B"}
    for k, g in got.items():
        v = one(tail.historical_var(t, 0.95, 5), series_id=k)
        e = one(tail.historical_es(t, 0.95, 5), series_id=k)
        assert (g.var_return, g.es_return) == (pytest.approx(v.var_return), pytest.approx(e.es_return))
        assert (g.var_tail_observations, g.tail_observations, g.n_observations) == (v.tail_observations, e.tail_observations, v.n_observations)


def test_nothing_at_all(spark):
    assert order.long_tail(table(spark, {"A": [None]})).count() == 0
