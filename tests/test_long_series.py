"""Windows over series that no task holds: parts, carried totals and halos against the plain windows."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import backtest, beta, blocks, drawdown, returns, sliding, tail, volatility

from .helpers import fat_returns, prices, table

N = 1600
PART = 100  # 16 parts for the long series


@pytest.fixture(scope="module")
def series(spark):
    """One series of 16 parts, one of a fraction of a part, one of a single row, one falling all along."""
    rng = np.random.default_rng(1)
    named = {"long": 100 * np.exp(np.cumsum(fat_returns(N))), "short": 50 + rng.random(30), "one": [7.0], "falls": 90.0 - np.arange(140) / 2}
    return prices(spark, named).cache()


@pytest.fixture(scope="module")
def logs(series):
    return returns.log_returns(series).cache()


def same(got, want, columns):
    rows = lambda df: sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b, strict=True) if not all(map(close, x, y))] == []


def test_no_task_holds_the_series(series):
    parts = blocks.Parts.of(series, part_rows=PART)
    scanned = parts.scan(_rn=("count", F.lit(1))).rows
    sizes = [r["count"] for r in scanned.groupBy("series_id", "_part").count().collect()]
    assert max(sizes) < 3 * PART  # ranges are sampled
    assert scanned.where("series_id = 'long'").select("_part").distinct().count() >= 10
    cut = parts.blocks(20, PART)
    assert max(r["count"] for r in cut.groupBy("series_id", "_block").count().collect()) == PART + 19
    assert cut.where("series_id = 'long' AND _own").select("_block").distinct().count() == N // PART


def test_row_numbers(series):
    got = blocks.Parts.of(series, part_rows=PART).scan(n=("count", F.lit(1)), low=("min", F.col("close")), total=("sum", F.col("close"))).rows
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.series_id, r.d)):
        held = by.setdefault(r.series_id, [])
        held.append(r.close)
        assert (r.n, r.low) == (len(held), min(held))
        assert r.total == pytest.approx(sum(held), rel=1e-12)


@pytest.mark.parametrize("method", ["log", "simple"])
def test_returns_and_index(series, method):
    plain = returns.compute_returns(series, method)
    long = blocks.long_returns(series, method, part_rows=PART)
    same(long, plain, ["series_id", "d", "r"])
    same(blocks.long_price_index(long, method, part_rows=PART), returns.price_index(plain, method), ["series_id", "d", "level"])


def test_drawdowns(series):
    same(blocks.long_drawdowns(series, part_rows=PART), drawdown.drawdowns(series), ["series_id", "d", "p", "peak", "dd"])
    plain = drawdown.drawdown_summary(series)
    same(blocks.long_drawdown_summary(series, part_rows=PART), plain, plain.columns)
    plain = drawdown.drawdown_episodes(series, 0.02)
    same(blocks.long_drawdown_episodes(series, 0.02, part_rows=PART), plain, plain.columns)


@pytest.mark.parametrize("window", [20, 250])
def test_moving_frames(series, logs, window):
    """Also frames longer than a part: blocks are never shorter than their halo."""
    same(blocks.long_rolling_volatility(logs, window, part_rows=PART), volatility.rolling_volatility(logs, window), ["series_id", "d", "vol"])
    same(blocks.long_rolling_var(logs, window, part_rows=PART), tail.rolling_historical_var(logs, window), ["series_id", "d", "r", "var"])
    market = logs.where("series_id = 'long'").withColumn("r", F.col("r") * 0.7 + F.sin(F.unix_date("d")) / 100)
    pairs = beta.align(logs, market)
    same(blocks.long_rolling_beta(pairs, window, part_rows=PART), beta.rolling_beta(pairs, window), ["series_id", "d", "rolling_beta"])


def test_runs_cross_parts(spark):
    r = random.Random(3)
    hits = {"a": [1] * 450 + [0] * 30 + [1] * 20, "b": [int(r.random() < 0.6) for _ in range(700)], "c": [0, 0]}
    scored = table(spark, hits, "is_breach").withColumn("is_breach", F.col("is_breach").cast("int"))
    same(blocks.long_runs(scored, part_rows=PART), backtest.longest_runs(scored), ["series_id", "max_consecutive"])
    assert {x.series_id: x.max_consecutive for x in blocks.long_runs(scored, part_rows=PART).collect()}["a"] == 450


def test_one_pass_gives_transitions_and_runs(spark):
    hits = {"a": [1, 1, 0, 1, 1, 1, 0, 0], "b": [0, 0], "c": [1]}
    scored = table(spark, hits, "is_breach").withColumn("is_breach", F.col("is_breach").cast("int"))
    counted = backtest.transition_counts(scored)
    got = {x.series_id: (x.n_observations, x.n_breaches, x.n00, x.n01, x.n10, x.n11, x.max_consecutive) for x in counted.collect()}
    assert got == {"a": (8, 5, 1, 1, 2, 3, 3), "b": (2, 0, 1, 0, 0, 0, 0), "c": (1, 1, 0, 0, 0, 0, 1)}
    assert counted._jdf.queryExecution().executedPlan().toString().count("Window [") <= 2  # one sort for all


# --- Sliding quantiles -----------------------------------------------------------------------


@pytest.mark.parametrize(("window", "p"), [(1, 0.5), (2, 0.0), (3, 1.0), (7, 0.05), (50, 0.05), (50, 0.5), (99, 0.987)])
def test_sliding_quantile_equals_numpy(window, p):
    rng = np.random.default_rng(window)
    for values in (rng.normal(size=400), rng.integers(0, 4, 400).astype(float), np.sort(rng.normal(size=300)), -np.sort(rng.normal(size=300)), np.zeros(200)):
        held = sliding.SlidingQuantile(window, p)
        got = [held.push(x) for x in values.tolist()]
        assert got[: window - 1] == [None] * (window - 1)
        want = [np.quantile(values[k - window + 1 : k + 1], p) for k in range(window - 1, len(values))]
        np.testing.assert_allclose(got[window - 1 :], want, rtol=1e-12, atol=1e-15)


def test_wide_windows_cost_little_more():
    x = np.random.default_rng(5).normal(size=30_000).tolist()

    def seconds(window):
        held, began = sliding.SlidingQuantile(window, 0.05), time.perf_counter()
        for v in x:
            held.push(v)
        return time.perf_counter() - began

    seconds(250)
    assert min(seconds(2500) for _ in range(3)) < 3 * min(seconds(250) for _ in range(3))


def test_heaps_stay_small():
    held = sliding.SlidingQuantile(100, 0.05)
    for x in np.random.default_rng(6).normal(size=20_000).tolist():
        held.push(x)
    assert len(held.low) < 400
    assert len(held.high) < 400


def test_series_are_kept_apart(spark):
    rng = np.random.default_rng(8)
    named = {str(k): rng.normal(size=rng.integers(1, 60)) for k in range(40)}
    r = table(spark, named).withColumn("Extra", F.lit("x")).withColumn("var", F.lit("old"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = tail.rolling_historical_var(r, 10, 0.9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, named.values()))
    assert all(x.Extra == "x" for x in got)
    for name, values in named.items():
        mine = [x.var for x in sorted((x for x in got if x.series_id == name), key=lambda x: x.d)]
        for k, v in enumerate(mine):
            want = None if k < 9 else -(math.exp(np.quantile(values[k - 9 : k + 1], 1 - 0.9)) - 1)
            assert v == pytest.approx(want, rel=1e-9) if want is not None else v is None
