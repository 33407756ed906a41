import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.functions.columns import rating, score
from tailframe.operators import composite, scorecard, valuation

from .helpers import normal_returns, one, prices

RATIOS = "entity string, fiscal_year int, interest_coverage double, debt_to_equity double, current_ratio double, cfo_to_net_income double, fcf_margin double, ebitda_margin double"


@pytest.mark.parametrize(("v", "safe", "dangerous", "want"), [(0.3, 0.3, 3.0, 0), (3.0, 0.3, 3.0, 100), (1.65, 0.3, 3.0, 50), (9.0, 0.3, 3.0, 100), (2.5, 2.5, 0.8, 0), (0.8, 2.5, 0.8, 100), (None, 0, 1, None), (float("nan"), 0, 1, None), (1.0, 1.0, 1.0, None)])
def test_scores(spark, v, safe, dangerous, want):
    got = spark.createDataFrame([(v,)], "v double").select(score("v", safe, dangerous)).first()[0]
    assert got == (None if want is None else pytest.approx(want))


def test_ratings(spark):
    df = spark.createDataFrame([(x,) for x in (70.0, 69.9, 50.0, 30.0, 29.9, None)], "v double").select(rating("v"))
    assert [r[0] for r in df.collect()] == ["High", "Elevated", "Elevated", "Moderate", "Low", "Low"]


def test_fundamental_pillars_by_hand(spark):
    rows = [("E", 2020 + k, 10.0 - 2 * k, 1.0 + 0.5 * k, 1.0 - 0.1 * k, 0.7, -0.01, 0.3 - 0.03 * k) for k in range(5)]
    f = one(scorecard.fundamental(spark.createDataFrame(rows, RATIOS)))
    assert f.last_year == 2024
    assert f.slope_interest_coverage == pytest.approx(-2.0)
    assert f.leverage_risk == pytest.approx(np.mean([100 * (3.0 - 0.3) / 2.7, 100]))
    assert f.liquidity_risk == 100
    assert f.earnings_quality_risk == pytest.approx(np.mean([100 * 0.6 / 0.7, 100 * 0.21 / 0.25]))
    assert f.deterioration_risk == pytest.approx(np.mean([100, 100 * (0.1 + 0.1) / 0.3, 100, 100, 25]))
    assert [(x.category, x.severity) for x in f.flags] == [("Leverage", "elevated"), ("Liquidity", "critical"), ("Earnings quality", "elevated"), ("Cash generation", "elevated"), *[("Deterioration", "elevated")] * 3]
    assert f.rating == "High"


def test_missing_ratios_are_named_and_not_scored(spark):
    rows = [("E", 2020 + k, None, float("nan"), 2.5, 1.3, 0.2, None) for k in range(2)]
    f = one(scorecard.fundamental(spark.createDataFrame(rows, RATIOS)))
    assert f.unavailable == ["debt_to_equity", "interest_coverage"]
    assert (f.leverage_risk, f.liquidity_risk, f.deterioration_risk) == (None, 0.0, None)
    assert f.overall_risk == 0.0  # two years are too few for the sustained conversion and for slopes
    assert f.flags == []


def test_slopes_run_over_positions(spark):
    rows = [("E", y, v, 1.0, 1.0, 1.0, 0.1, 0.1) for y, v in ((2019, 1.0), (2020, 4.0), (2021, None), (2022, 3.0), (2023, 2.0))]
    s = {r.metric: r for r in scorecard.slopes(scorecard.recent_years(spark.createDataFrame(rows, RATIOS))).collect()}
    assert s["interest_coverage"].slope == pytest.approx(-1.0)  # positions 0, 1, 2, not years
    assert s["interest_coverage"].n_years == 3


@pytest.mark.parametrize(("overall", "vol", "peer", "verdict"), [(80.0, 0.15, None, "fundamental risk exceeds market risk"), (10.0, 0.55, None, "market risk exceeds fundamental risk"), (40.0, 0.35, None, "the two measures broadly agree"), (None, 0.35, None, "the two measures broadly agree"), (80.0, 0.2, 0.4, "fundamental risk exceeds market risk"), (25.0, 0.2, 0.4, "the two measures broadly agree"), (100.0, 0.9, 0.3, "the two measures broadly agree")])
def test_market_comparison(spark, overall, vol, peer, verdict):
    df = spark.createDataFrame([(overall, vol, peer)], "overall_risk double, volatility double, peer double")
    assert one(scorecard.compare_with_market(df, peer="peer")).verdict == verdict


MARKET = "entity string, volatility double, var_99 double, max_drawdown double, beta double, beta_confidence string, regime string"


def test_market_score(spark):
    rows = [("a", 0.35, 0.05, -0.375, 1.65, "high", "normal"), ("b", 0.35, 0.05, -0.375, 1.65, "low", "elevated"), ("c", 0.15, 0.02, -0.1, None, None, "subdued"), ("d", 0.9, 0.9, -0.9, 9.0, "high", "elevated")]
    got = {r.entity: r for r in scorecard.score_market(spark.createDataFrame(rows, MARKET)).collect()}
    assert [got[k].market_score for k in "abcd"] == pytest.approx([50, 58, 0, 100])
    assert [got[k].excluded for k in "abcd"] == [[], ["beta"], [], []]


BASE = "entity string, fcff array<double>, net_debt double, shares double, share_price double, wacc double, terminal_growth double"


def linear(wacc, growth):
    return F.lit(50.0) + growth * 2000


@pytest.mark.parametrize(("price", "want"), [(100.0, 0.025), (50.0, 0.0), (10_000.0, None), (-200.0, None)])
def test_implied_growth_of_a_linear_pricer(spark, price, want):
    df = spark.createDataFrame([("E", [1.0], 0.0, 1.0, price, 0.09, 0.02)], BASE)
    got = df.select(valuation.implied_growth(F.col("wacc"), F.col("share_price"), linear)).first()[0]
    assert got == (None if want is None else pytest.approx(want, abs=1e-9))


def test_implied_growth_steps_down_where_the_top_has_no_price(spark):
    patchy = lambda w, g: F.when(g <= 0.04, linear(w, g))
    df = spark.createDataFrame([("E", [1.0], 0.0, 1.0, 100.0, 0.09, 0.02)], BASE)
    assert df.select(valuation.implied_growth(F.col("wacc"), F.col("share_price"), patchy)).first()[0] == pytest.approx(0.025)


def test_sensitivity_is_free_of_level_bias(spark):
    df = spark.createDataFrame([("E", [1.0], 0.0, 1.0, 80.0, 0.09, 0.02)], BASE)
    share = lambda w, g: F.lit(0.6)
    a, b = (one(valuation.assess(df, lambda w, g, k=k: k * 100.0 * 0.09 / w, share)).wacc_sensitivity for k in (1.0, 0.4))
    assert a == pytest.approx(b)
    assert a == pytest.approx((0.09 / 0.0875 - 0.09 / 0.0925) / 2)


def test_grid_and_scenarios(spark):
    df = spark.createDataFrame([("E", [10.0, 11.0, 12.0], 20.0, 10.0, 15.0, 0.03, 0.02)], BASE)
    g = valuation.grid(df).collect()
    assert len(g) == 25
    assert all((r.price is None) == (0.02 + r.d_growth >= 0.03 + r.d_wacc - 0.005) for r in g)
    s = {r.scenario: r for r in valuation.stress(df).collect()}
    assert len(s) == 7
    assert s["Base case"].vs_base == 0.0
    assert s["Rates rise 200bp"].implied_price < s["Rates rise 100bp"].implied_price < s["Base case"].implied_price
    w, t = 0.05, 0.02
    want = (sum(x / (1 + w) ** (k + 1) for k, x in enumerate((10.0, 11.0, 12.0))) + 12 * (1 + t) / (w - t) / (1 + w) ** 3 - 20) / 10
    assert s["Rates rise 200bp"].implied_price == pytest.approx(want)
    assert s["Rates rise 200bp"].vs_market == pytest.approx(want / 15 - 1)


def test_flags_of_a_valuation(spark):
    df = spark.createDataFrame([("E", [1.0], 0.0, 1.0, 130.0, 0.09, 0.02, 0.05), ("Z", [1.0], 0.0, 1.0, 130.0, 0.09, 0.02, 0.0)], BASE + ", market_implied_wacc double")
    got = {r.entity: r for r in valuation.assess(df, lambda w, g: linear(w, g) - w * 900 + 81, lambda w, g: F.lit(0.86)).collect()}
    assert got["E"].assumption_dependence == "Critical"
    assert "the market implies another discount rate" in got["E"].flags
    assert got["Z"].market_implied_wacc is None  # exactly 0 counts as unknown


VALUE = "entity string, terminal_share double, wacc_sensitivity double, wacc double, market_implied_wacc double"


def test_composite_degrades_by_dimension(spark):
    market = scorecard.score_market(spark.createDataFrame([(k, 0.35, 0.05, -0.375, 1.65, "high", "elevated") for k in "abc"], MARKET))
    fundamentals = spark.createDataFrame([("a", 100.0, 60.0), ("b", 20.0, 10.0)], "entity string, overall_risk double, deterioration_risk double")
    valuations = spark.createDataFrame([("a", 0.80, -0.06, 0.09, 0.06), ("c", None, None, None, None)], VALUE)
    got = {r.entity: r for r in scorecard.compose(market, fundamentals, valuations).collect()}
    v = np.average([100 * 0.4 / 0.45, 100 * 0.04 / 0.06, 50], weights=[0.40, 0.35, 0.25])
    assert got["a"].overall == pytest.approx(0.4 * 58 + 0.3 * 100 + 0.3 * v)
    assert [(d.kind, d.severity) for d in got["a"].divergences] == [("fundamental_vs_market", "critical"), ("valuation_vs_regime", "elevated"), ("deteriorating_vs_terminal", "elevated")]
    assert got["b"].overall == pytest.approx((0.4 * 58 + 0.3 * 20) / 0.7)
    assert got["b"].weights_used == pytest.approx({"market": 4 / 7, "fundamental": 3 / 7})
    assert got["b"].excluded_dimensions == ["valuation"]
    assert [d.severity for d in got["b"].divergences] == ["note"]
    # There is a valuation but it has no score: it weighs nothing and isn't named.
    assert (got["c"].overall, got["c"].excluded_dimensions) == (pytest.approx(58), ["fundamental"])
    alone = one(scorecard.compose(market.where("entity = 'a'")))
    assert (alone.overall, alone.excluded_dimensions, alone.verdict) == (pytest.approx(58), ["fundamental", "valuation"], None)


def test_end_to_end(spark):
    p = prices(spark, {"A": 100 * np.exp(np.cumsum(normal_returns(400, 1))), "B": [1.0, 2.0, 3.0]})
    b = prices(spark, {"M": 100 * np.exp(np.cumsum(normal_returns(400, 2)))})
    got = {r.entity: r for r in composite.assess(p, b).collect()}
    assert 0 <= got["A"].overall <= 100
    assert got["A"].weights_used == {"market": 1.0}
    m = one(composite.market_measures(p, b), series_id="B")
    assert (m.regime, m.beta_confidence) == ("normal", "low")
