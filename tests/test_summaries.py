import pytest

from tailframe.functions import summaries
from tailframe.operators import backtest, composite, fit, portfolio, simulate, tail

from .helpers import garch_returns, normal_returns, prices, table


def texts(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_tail_texts(spark):
    t = table(spark, {"A": normal_returns(400), "B": [0.1]})
    got = sorted(texts(tail.historical_var(t, 0.99, 10), summaries.var_summary()), key=str)
    assert got[0].startswith("Historical VaR, 99% over 10 day(s): a loss of ")
    assert got[1] is None  # a series without an estimate has no text
    assert "beyond a VaR of" in texts(tail.historical_es(t), summaries.es_summary())[0]
    assert "standard error" in texts(simulate.monte_carlo(t.where("series_id = 'A'"), paths=500), summaries.simulation_summary())[0]
    assert "isn't rejected" in texts(tail.fit_distribution(t.where("series_id = 'A'")), summaries.distribution_verdict())[0]


def test_model_texts(spark):
    t = table(spark, {"G": garch_returns(900)})
    assert "volatility clusters" in texts(fit.arch_tests(t), summaries.arch_reading())[0]
    assert "a shock halves in" in texts(fit.fit_garch(t, "normal"), summaries.garch_summary())[0]
    s = tail.mark_breaches(tail.rolling_historical_var(t, 100))
    assert " breaches in 801 days" in texts(backtest.backtest(s), summaries.backtest_reading())[0]


def test_portfolio_and_composite_texts(spark):
    t = table(spark, {"A": normal_returns(200, 1), "B": normal_returns(200, 2)})
    w = spark.createDataFrame([("P", "A", 0.5), ("P", "B", 0.5)], "portfolio_id string, series_id string, w double")
    assert texts(portfolio.analyse(t, w), summaries.portfolio_summary())[0].startswith("2 holdings that count as 2.0")
    import numpy as np

    c = composite.assess(prices(spark, {"A": 100 * np.exp(np.cumsum(normal_returns(300)))}))
    assert texts(c, summaries.composite_summary())[0].endswith("; without fundamental, valuation")


@pytest.mark.parametrize("name", [n for n in dir(summaries) if n.endswith(("_summary", "_reading", "_verdict"))])
def test_every_text_is_an_expression(spark, name):
    assert "format_string" in str(getattr(summaries, name)())
