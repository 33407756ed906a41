import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import backtest, scorecard, tail, valuation
from tailframe.operators.views import Views
from tailframe.sources import engines

from .helpers import fat_returns, one, prices


def test_views_compute_once(spark):
    p = prices(spark, {"a": 100 * np.exp(np.cumsum(fat_returns(700)))})
    asked = []

    def load():
        asked.append(1)
        return p

    v = Views(spark, load)
    first = one(v.backtests(0.95, 250))
    assert one(v.zones(0.95, 250)).n_days == 250
    assert one(v.overview()).n_observations == 699
    assert asked == [1]
    assert v.scored(0.95, 250) is v.scored(0.95, 250)
    want = one(backtest.backtest(tail.mark_breaches(tail.rolling_historical_var(v.returns(), 250))))
    assert (first.n_breaches, first.kupiec_p) == (want.n_breaches, pytest.approx(want.kupiec_p))
    assert one(v.garch("normal")).omega > 0
    v.clear()
    v.prices()
    assert asked == [1, 1]
    v.clear()


def test_old_views_are_computed_anew(spark):
    asked = []
    p = prices(spark, {"a": [1.0, 2.0]})
    v = Views(spark, lambda: asked.append(1) or p, seconds=-1)
    v.prices()
    v.prices()
    assert len(asked) == 2
    v.clear()


def annual(entity):
    if entity == "none":
        return []
    return [{"fiscal_year": 2020 + k, "interest_coverage": 5.0 - k, "debt_to_equity": 1.0 + k / 10, "current_ratio": 1.5} for k in range(4)]


def inputs(entity):
    return [{"fcff": [100.0, 103.0, 106.0], "net_debt": 10.0, "shares": 50.0, "share_price": 30.0, "wacc": 0.08, "terminal_growth": 0.02}]


def test_engines_feed_the_scorecard_and_the_valuation(spark):
    e = spark.createDataFrame([("x",), ("x",), ("none",)], "entity string")
    got = engines.ratios(e, annual)
    assert got.count() == 4
    f = one(scorecard.fundamental(got))
    assert (f.entity, f.last_year) == ("x", 2023)
    assert got.where(F.col("fcf_margin").isNull()).count() == 4
    v = one(valuation.assess(engines.valuation_inputs(e.where("entity = 'x'"), inputs)))
    assert v.implied_price > 0
    assert v.market_implied_wacc is None


def test_an_absent_engine_raises_with_a_hint(spark):
    e = spark.createDataFrame([("x",)], "entity string")
    for name in ("no_such_package.company:analyse", "json", "json.no_such:f"):
        with pytest.raises(ImportError, match="isn't installed: install"):
            engines.ratios(e, name)
    assert engines.found("json:loads", "") == "json:loads"
    assert engines._load("json:loads")("[1]") == [1]
