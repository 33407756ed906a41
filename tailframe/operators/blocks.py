"""Windows over series too long for one task.

A window by series brings a whole series into one task. Here a series is cut into parts by Spark's range
partitioning of (series, time), which samples the keys, so that parts are even whatever the lengths of the
series. Two ways lead from parts to windows:

* running totals in two phases: each part's total, the totals carried over the parts before it (a row a
  part), and a window inside the part that starts from what is carried;
* moving frames over blocks with a halo: with global row numbers, which are such a running total, blocks of
  equal length are cut and the last w - 1 rows of each are copied into the next one.

A task holds a part, or a block and its halo. Results equal those of the windows by series, but for the
order in which sums add up. Times within a series should differ, as they should for any ordered window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, present
from tailframe.plans import settings as S
from tailframe.plans.storage import stored

from . import beta, returns, tail, volatility
from .frames import BY

#: Rows of a part, about, and rows of a block (without its halo).
PART_ROWS = 1_000_000

#: How two totals combine, and what nothing adds up to.
KINDS: dict[str, tuple[Callable, Callable, float | None]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "count": (lambda c: F.count(c), lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "max": (F.max, F.greatest, None),  # greatest() and least() skip NULLs
    "min": (F.min, F.least, None),
}


class Parts:
    """A table cut into parts: rows with the column _part, which rises with time inside each series."""

    def __init__(self, rows: DataFrame, by=BY, time: str = "d"):
        self.rows, self.by, self.time = rows, list(by), time

    @classmethod
    def of(cls, df: DataFrame, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> Parts:
        """Stored once: sampled ranges must not be drawn anew when a task is repeated."""
        parts = max(1, -(-df.count() // part_rows))
        dealt = df.repartitionByRange(parts, *by, time).withColumn("_part", F.spark_partition_id())
        return cls(stored(dealt, "parts"), by, time)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Parts:
        return Parts(change(self.rows), self.by, self.time)

    def scan(self, **totals: tuple[str, Column]) -> Parts:
        """Adds a column for each of totals (kind, column): the total of the series so far, this row included."""
        at = [*self.by, "_part"]
        sums = self.rows.groupBy(*at).agg(*(KINDS[kind][0](c).alias(f"_{name}") for name, (kind, c) in totals.items()))
        earlier = W.partitionBy(*self.by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carry = lambda kind, name: {"count": F.sum}.get(kind, KINDS[kind][0])(f"_{name}").over(earlier)
        carried = sums.select(*at, *(carry(kind, name).alias(f"_{name}") for name, (kind, _) in totals.items()))
        inside = W.partitionBy(*at).orderBy(self.time).rowsBetween(W.unboundedPreceding, 0)
        out = self.rows.join(carried, at)
        for name, (kind, c) in totals.items():
            total, combine, nothing = KINDS[kind]
            before = F.col(f"_{name}") if nothing is None else F.coalesce(F.col(f"_{name}"), F.lit(nothing))
            out = out.withColumn(name, combine(before, total(c).over(inside)))
        return Parts(out.drop(*(f"_{name}" for name in totals)), self.by, self.time)

    def blocks(self, window: int, block_rows: int = PART_ROWS) -> DataFrame:
        """The rows with _block, and _own: false for the copies of the window - 1 rows before a block."""
        length = max(block_rows, window - 1, 1)
        n = self.scan(_rn=("count", F.lit(1))).rows.withColumn("_at", F.col("_rn") - 1)
        block, inside = F.floor(F.col("_at") / length), F.col("_at") % length
        place = lambda b, own: F.struct(b.alias("_block"), F.lit(own).alias("_own"))
        places = F.when(inside >= length - (window - 1), F.array(place(block, True), place(block + 1, False))).otherwise(F.array(place(block, True)))
        return n.select("*", F.inline(places)).drop("_at", "_part", "_rn")

    def moving(self, window: int, compute: Callable[[DataFrame, tuple], DataFrame], block_rows: int = PART_ROWS) -> DataFrame:
        """compute(df, by): any operator with a frame of at most `window` rows, run block by block."""
        out = compute(self.blocks(window, block_rows), (*self.by, "_block"))
        return out.where("_own").drop("_own", "_block") if "_own" in out.columns else out.drop("_block")


def long_returns(prices: DataFrame, method: str = "log", price: str = "adj_close", by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    """returns.compute_returns() of long series."""
    parts = Parts.of(prices.select(*by, time, price), by, time, part_rows)
    # A copied row opens its block, has no row before it and so no return.
    return parts.moving(2, lambda df, at: returns.compute_returns(df, method, price, at, time), part_rows)


def long_price_index(log_or_simple: DataFrame, method: str = "log", base: float = 100.0, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    parts = Parts.of(log_or_simple.where(present("r")), by, time, part_rows)
    level = ("sum", F.col("r")) if method == "log" else ("product", F.col("r") + 1)
    out = parts.scan(level=level).rows.drop("_part")
    return out.withColumn("level", dbl(base) * (F.exp("level") if method == "log" else F.col("level")))


def _peaks(prices: DataFrame, price: str, by, time: str, part_rows: int) -> Parts:
    p = prices.where(present(price)).select(*by, time, F.col(price).alias("p"))
    parts = Parts.of(p, by, time, part_rows).scan(peak=("max", F.col("p")), _rn=("count", F.lit(1)))
    return parts.map(lambda df: df.withColumn("dd", (F.col("p") - F.col("peak")) / F.col("peak")))


def long_drawdowns(prices: DataFrame, price: str = "adj_close", by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    return _peaks(prices, price, by, time, part_rows).rows.drop("_part", "_rn")


def long_drawdown_summary(prices: DataFrame, price: str = "adj_close", by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    dd = _peaks(prices, price, by, time, part_rows).rows
    out = dd.groupBy(*by).agg(F.max_by("dd", time).alias("current_drawdown"), F.min(F.struct("dd", time)).alias("_worst"), (F.max("_rn") - F.max(F.when(F.col("p") >= F.col("peak"), F.col("_rn")))).alias("current_duration_days"))
    return out.select(*by, "current_drawdown", F.col("_worst.dd").alias("max_drawdown"), F.col(f"_worst.{time}").alias("max_drawdown_date"), "current_duration_days", (F.col("current_drawdown") < dbl(S.DRAWDOWN_TOLERANCE)).alias("is_in_drawdown"))


def long_drawdown_episodes(prices: DataFrame, min_depth: float = S.EPISODE_DEPTH, price: str = "adj_close", by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    """drawdown.drawdown_episodes() of long series: the groups that rows at the peak open come from a second
    running total, and the next group is met by its number, not by a window over the groups."""
    by = list(by)
    parts = _peaks(prices, price, by, time, part_rows).map(lambda df: df.withColumn("_top", (F.col("p") >= F.col("peak") - dbl(S.PEAK_TOLERANCE)).cast("int")))
    rows = parts.scan(_group=("sum", F.col("_top"))).rows
    top, low = F.col("_top") == 1, F.col("_top") == 0
    groups = rows.groupBy(*by, "_group").agg(F.max(F.when(top, F.struct(F.col(time).alias("at"), "_rn", "p"))).alias("_peak"), F.min(F.when(low, F.struct("p", "_rn", F.col(time).alias("at")))).alias("_trough"))
    groups = stored(groups, "groups")
    depth = (F.col("_trough.p") - F.col("_peak.p")) / F.col("_peak.p")
    fallen = groups.where(F.col("_trough").isNotNull() & (depth <= dbl(-min_depth)))
    after = groups.select(*by, (F.col("_group") - 1).alias("_group"), F.col("_peak").alias("_next"))
    return fallen.join(after, [*by, "_group"], "left").select(
        *by,
        F.col("_peak.at").alias("peak_date"),
        F.col("_trough.at").alias("trough_date"),
        depth.alias("depth"),
        (F.col("_trough._rn") - F.col("_peak._rn")).cast("long").alias("days_to_trough"),
        F.col("_next.at").alias("recovery_date"),
        (F.col("_next._rn") - F.col("_trough._rn")).cast("long").alias("days_to_recovery"),
    )


def long_runs(scored: DataFrame, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    """backtest.longest_runs() of long series: an island is a value of (rows - breaches) so far."""
    parts = Parts.of(scored.select(*by, time, "is_breach"), by, time, part_rows)
    rows = parts.scan(_rn=("count", F.lit(1)), _hits=("sum", F.col("is_breach"))).rows
    runs = rows.groupBy(*by, (F.col("_rn") - F.col("_hits")).alias("_island")).agg(F.sum("is_breach").alias("_run"))
    return runs.groupBy(*by).agg(F.max("_run").cast("long").alias("max_consecutive"))


def long_rolling_volatility(log_returns: DataFrame, window: int = S.ROLLING_WINDOW, annualise: bool = True, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    parts = Parts.of(log_returns, by, time, part_rows)
    return parts.moving(window, lambda df, at: volatility.rolling_volatility(df, window, annualise, at, time), part_rows)


def long_rolling_beta(aligned: DataFrame, window: int = S.ROLLING_WINDOW, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    parts = Parts.of(aligned, by, time, part_rows)
    return parts.moving(window, lambda df, at: beta.rolling_beta(df, window, at, time), part_rows)


def long_rolling_var(log_returns: DataFrame, window: int = 252, confidence: float = S.CONFIDENCE, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    parts = Parts.of(log_returns.where(present("r")), by, time, part_rows)
    return parts.moving(window, lambda df, at: tail.rolling_historical_var(df, window, confidence, at, time), part_rows)
