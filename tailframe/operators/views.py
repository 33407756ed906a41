"""The results that several views of a session ask for, each computed once in 900 seconds.

Prices, returns, fits and backtests are stored tables (storage.Memo), so a second view reads what the first one
has written, and no view recomputes the steps below its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tailframe.plans import settings as S
from tailframe.plans.storage import Memo

from . import backtest, fit, returns, tail, volatility


class Views:
    """load(): cleaned prices of the session's series."""

    def __init__(self, spark: SparkSession, load: Callable[[], DataFrame], seconds: float = 900):
        self.load, self.memo = load, Memo(spark, seconds)

    def prices(self) -> DataFrame:
        return self.memo.get(("prices",), self.load)

    def returns(self) -> DataFrame:
        return self.memo.get(("returns",), lambda: returns.log_returns(self.prices()))

    def garch(self, distribution: str = "t") -> DataFrame:
        return self.memo.get(("garch", distribution), lambda: fit.fit_garch(self.returns(), distribution))

    def scored(self, confidence: float = S.CONFIDENCE, window: int = 500) -> DataFrame:
        """Rolling VaR against what came, day by day."""
        return self.memo.get(("scored", confidence, window), lambda: tail.mark_breaches(tail.rolling_historical_var(self.returns(), window, confidence)))

    def overview(self, confidence: float = S.CONFIDENCE) -> DataFrame:
        vol = volatility.historical_volatility(self.returns()).select("series_id", "annualised", "n_observations")
        es = tail.historical_es(self.returns(), confidence).select("series_id", "var_return", "es_return")
        return vol.join(es, "series_id")

    def backtests(self, confidence: float = S.CONFIDENCE, window: int = 500) -> DataFrame:
        return backtest.backtest(self.scored(confidence, window), confidence)

    def zones(self, confidence: float = 0.99, window: int = 500) -> DataFrame:
        return backtest.basel(self.scored(confidence, window))

    def clear(self) -> None:
        self.memo.clear()
