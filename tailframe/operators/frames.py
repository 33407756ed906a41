"""Window specifications that every operator shares: identical ones become one sort."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec

from tailframe.functions.columns import col

BY = ("series_id",)


def ordered(by=BY, time: str = "d") -> WindowSpec:
    return Window.partitionBy(*map(col, by)).orderBy(time)


def so_far(by=BY, time: str = "d") -> WindowSpec:
    return ordered(by, time).rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int, by=BY, time: str = "d") -> WindowSpec:
    return ordered(by, time).rowsBetween(-(n - 1), 0)


def whole(by=BY) -> WindowSpec:
    return Window.partitionBy(*map(col, by))
