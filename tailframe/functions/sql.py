"""The SQL surface: temporary functions, pandas UDFs and a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from tailframe.plans import settings as S
from tailframe.plans.shipping import ship

from . import specfun

EXPRESSIONS = {
    "risk_score(v DOUBLE, safe DOUBLE, dangerous DOUBLE)": "CASE WHEN v IS NULL OR isnan(v) OR safe = dangerous THEN NULL ELSE greatest(0D, least(1D, (v - safe) / (dangerous - safe))) * 100 END",
    "log_loss(r DOUBLE)": "-(exp(r) - 1)",
    "scale_days(q DOUBLE, days INT)": "q * sqrt(days)",
    "basel_zone(breaches BIGINT, days BIGINT)": f"CASE WHEN breaches <= {S.BASEL_GREEN} * days / {float(S.BASEL_DAYS)}D THEN 'green' WHEN breaches <= {S.BASEL_YELLOW} * days / {float(S.BASEL_DAYS)}D THEN 'yellow' ELSE 'red' END",
    "risk_rating(v DOUBLE)": "CASE WHEN v >= 70 THEN 'High' WHEN v >= 50 THEN 'Elevated' WHEN v >= 30 THEN 'Moderate' ELSE 'Low' END",
}


class DrawdownEpisodes:
    """SELECT * FROM drawdown_episodes(0.1D, TABLE(t) PARTITION BY series_id ORDER BY d): t has the
    columns series_id, d and p. One pass with constant state."""

    def __init__(self):
        self.peak = self.low = None
        self.depth = 0.1

    def eval(self, depth: float, row: Row) -> Iterator[tuple]:
        self.depth, p, d = depth, row["p"], row["d"]
        if p is None:
            return
        self.series = row["series_id"]
        if self.peak is None or p >= self.peak[0] - S.PEAK_TOLERANCE:
            yield from self._close(d)
            self.peak, self.low = (max(p, self.peak[0]) if self.peak and p < self.peak[0] else p, d), None
        elif self.low is None or p < self.low[0]:
            self.low = (p, d)

    def _close(self, recovered) -> Iterator[tuple]:
        if self.low is not None:
            fall = (self.low[0] - self.peak[0]) / self.peak[0]
            if fall <= -self.depth:
                yield self.series, self.peak[1], self.low[1], fall, recovered

    def terminate(self) -> Iterator[tuple]:
        yield from self._close(None)


def register(spark: SparkSession) -> None:
    """Makes everything here callable from spark.sql in this session."""
    ship(spark)
    for head, body in EXPRESSIONS.items():
        kind = "STRING" if "'" in body else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udf.register("chi2_tail_1", specfun.chi2_p1)
    spark.udf.register("t_quantile", specfun.t_quantile)
    spark.udf.register("t_density", specfun.t_density)
    spark.udf.register("t_p_value", specfun.t_p_value)
    spark.udtf.register("drawdown_episodes", F.udtf(DrawdownEpisodes, returnType="series_id string, peak_date date, trough_date date, depth double, recovery_date date"))
