"""Drawdowns from running peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, present
from tailframe.plans import settings as S

from .frames import BY, ordered, so_far


def drawdowns(prices: DataFrame, price: str = "adj_close", by=BY, time: str = "d") -> DataFrame:
    """by, time, p, peak and dd = (p - peak) / peak."""
    p = prices.where(present(price)).select(*by, time, F.col(price).alias("p"))
    p = p.withColumn("peak", F.max("p").over(so_far(by, time)))
    return p.withColumn("dd", (F.col("p") - F.col("peak")) / F.col("peak"))


def drawdown_summary(prices: DataFrame, price: str = "adj_close", by=BY, time: str = "d") -> DataFrame:
    """Current and largest drawdown (at its first day), and rows since the last peak."""
    dd = drawdowns(prices, price, by, time).withColumn("_rn", F.row_number().over(ordered(by, time)))
    out = dd.groupBy(*by).agg(
        F.max_by("dd", time).alias("current_drawdown"),
        F.min(F.struct("dd", time)).alias("_worst"),
        (F.max("_rn") - F.max(F.when(F.col("p") >= F.col("peak"), F.col("_rn")))).cast("long").alias("current_duration_days"),
    )
    return out.select(
        *by,
        "current_drawdown",
        F.col("_worst.dd").alias("max_drawdown"),
        F.col(f"_worst.{time}").alias("max_drawdown_date"),
        "current_duration_days",
        (F.col("current_drawdown") < dbl(S.DRAWDOWN_TOLERANCE)).alias("is_in_drawdown"),
    )


def drawdown_episodes(prices: DataFrame, min_depth: float = S.EPISODE_DEPTH, price: str = "adj_close", by=BY, time: str = "d") -> DataFrame:
    """Peak, trough and recovery of each fall of at least min_depth. Every row at the running peak
    opens a group; the rows below it until the next one are its fall, the first lowest its trough,
    and the next group's opening its recovery (NULL while it's open). Durations are in rows."""
    w = ordered(by, time)
    dd = drawdowns(prices, price, by, time)
    dd = dd.withColumn("_top", (F.col("p") >= F.col("peak") - dbl(S.PEAK_TOLERANCE)).cast("int"))
    dd = dd.withColumn("_group", F.sum("_top").over(so_far(by, time))).withColumn("_rn", F.row_number().over(w))
    top, low = F.col("_top") == 1, F.col("_top") == 0
    groups = dd.groupBy(*by, "_group").agg(
        F.max(F.when(top, F.struct(F.col(time).alias("at"), "_rn", "p"))).alias("_peak"),
        F.min(F.when(low, F.struct("p", "_rn", F.col(time).alias("at")))).alias("_trough"),
    )
    after = ordered(by, "_group")
    groups = groups.withColumn("_next", F.lead("_peak").over(after))
    depth = (F.col("_trough.p") - F.col("_peak.p")) / F.col("_peak.p")
    return groups.where(F.col("_trough").isNotNull() & (depth <= dbl(-min_depth))).select(
        *by,
        F.col("_peak.at").alias("peak_date"),
        F.col("_trough.at").alias("trough_date"),
        depth.alias("depth"),
        (F.col("_trough._rn") - F.col("_peak._rn")).cast("long").alias("days_to_trough"),
        F.col("_next.at").alias("recovery_date"),
        (F.col("_next._rn") - F.col("_trough._rn")).cast("long").alias("days_to_recovery"),
    )


def curve_drawdown(simple_returns: DataFrame, by=BY, time: str = "d") -> DataFrame:
    """Largest drawdown of the curve of compounded simple returns. Its first peak is the first
    day's level, so a loss on that day doesn't show."""
    curve = simple_returns.withColumn("_level", F.product(F.col("r") + 1).over(so_far(by, time)))
    curve = curve.withColumn("_dd", F.col("_level") / F.max("_level").over(so_far(by, time)) - 1)
    return curve.groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))
