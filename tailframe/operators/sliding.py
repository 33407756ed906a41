"""Quantiles of sliding windows in O(log w) a row.

A windowed percentile sorts its whole frame for every row. Here the rows of a series stream
through two heaps, sorted by time: the smallest values up to the wanted rank, and the rest. A row that
leaves the window is only marked; heaps drop marked entries when these come to their top, or when they are
most of a heap. A task holds one window, whatever the length of a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tailframe.plans.shipping import ship

from .frames import BY


class SlidingQuantile:
    """The linearly interpolated p-quantile of the last `window` values."""

    def __init__(self, window: int, p: float):
        if window < 1 or not 0 <= p <= 1:
            raise ValueError(f"no quantile {p} of {window} values")
        at = (window - 1) * p
        self.window, self.rank, self.share = window, math.floor(at), at - math.floor(at)
        self.clear()

    def clear(self) -> None:
        self.low: list[tuple[float, int]] = []  # minus the value, and its number: the largest comes first
        self.high: list[tuple[float, int]] = []
        self.is_low = [False] * self.window  # by number modulo window
        self.n, self.n_low = 0, 0

    def _fresh(self, heap: list[tuple[float, int]], low: bool) -> None:
        """Drops from the top what has left the window or moved to the other heap."""
        oldest = self.n - self.window
        while heap and (heap[0][1] < oldest or self.is_low[heap[0][1] % self.window] != low):
            heappop(heap)

    def _compact(self, heap: list[tuple[float, int]], low: bool) -> None:
        """Entries that never come to the top go once they are most of a heap."""
        oldest = self.n - self.window
        heap[:] = [x for x in heap if x[1] >= oldest and self.is_low[x[1] % self.window] == low]
        heapify(heap)

    def push(self, x: float) -> float | None:
        """The quantile once the window is full, else None."""
        if len(self.high) > 2 * self.window + 64:
            self._compact(self.high, False)
        if len(self.low) > 2 * self.window + 64:
            self._compact(self.low, True)
        seat = self.n % self.window
        if self.n >= self.window and self.is_low[seat]:
            self.n_low -= 1
        self.n += 1
        low, high = self.low, self.high
        self.is_low[seat] = False  # so that the entry that leaves counts as gone
        self._fresh(low, True)
        if low and x < -low[0][0]:
            self.is_low[seat] = True
            self.n_low += 1
            heappush(low, (-x, self.n - 1))
        else:
            heappush(high, (x, self.n - 1))
        want = min(self.rank + 1, self.n, self.window)
        while self.n_low < want:
            self._fresh(high, False)
            value, k = heappop(high)
            self.is_low[k % self.window] = True
            self.n_low += 1
            heappush(low, (-value, k))
        while self.n_low > want:
            self._fresh(low, True)
            value, k = heappop(low)
            self.is_low[k % self.window] = False
            self.n_low -= 1
            heappush(high, (-value, k))
        if self.n < self.window:
            return None
        self._fresh(low, True)
        a = -low[0][0]
        if not self.share:
            return a
        self._fresh(high, False)
        b = high[0][0]
        return a * (1 - self.share) + b * self.share


def rolling_quantile(df: DataFrame, value: str, window: int, p: float, name: str, by=BY, time: str = "d") -> DataFrame:
    """df with `name`: the p-quantile of `value` over the last `window` rows, this one included; NULL before.
    value may not be NULL. One shuffle by series; every other column is carried over."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(name, T.DoubleType())])
    keys, at = [names.index(c) for c in by], names.index(value)

    def starts(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
        """Where another series than the row before begins."""
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k)
            differ = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            gone = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= differ | (gone[1:] != gone[:-1])
        new[0] = tuple(batch.column(k)[0].as_py() for k in keys) != last
        return np.flatnonzero(new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = SlidingQuantile(window, p), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = starts(batch, last)
            values = batch.column(at).to_pylist()
            out: list[float | None] = []
            out += map(held.push, values[: new[0] if len(new) else len(values)])  # goes on with the series before
            for a, b in zip(new, [*new[1:], len(values)], strict=False):
                held.clear()
                out += map(held.push, values[a:b])
            last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, name])

    return df.select(*names).repartition(*by).sortWithinPartitions(*by, time).mapInArrow(run, schema)
