"""Draws that any engine can repeat: hashed numbers in integer arithmetic, a bootstrap by hashed weights, and
slices of a seeded stream.

* unit() hashes integers with products and squares modulo 2^31 - 1 alone, so the same draws can be written in SQL
  (unit_sql()).
* weighted_intervals() is a bootstrap that needs no sample in one place: in sample b a row counts as often as a
  Poisson number says that hashes (b, day). Weights below the wanted ranks are only summed; values are looked
  at between two order statistics that hold every sample's quantile.
* sliced_paths() gives the very numbers of simulate.draw_paths() for the bootstrap, in as many tasks as wanted: each
  jumps ahead in the generator's stream. A drawn word is rejected or not by its own value, so a first pass finds
  the rejected positions, and every slice knows where its draws begin.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, loss, present
from tailframe.plans import settings as S
from tailframe.plans.shipping import ship
from tailframe.plans.storage import stored

from . import order
from .frames import BY
from .tail import check

PRIME = 2**31 - 1
#: Widths of the range of order statistics for the samples' quantiles, in standard deviations of its rank.
DEVIATIONS = 8.0
#: Paths of a slice.
SLICE_PATHS = 100_000


def unit(seed: int, *values: Column) -> Column:
    """A number in (0, 1) from integers."""
    h = F.lit(seed % PRIME).cast("long")
    for v in values:
        h = (h * 48271 + F.pmod(v.cast("long"), F.lit(PRIME)) + 1) % PRIME
        h = (h * h + 12345) % PRIME  # squares, which no shift of the input survives
        h = (h * 69621 + 7) % PRIME
        h = (h * h + 16807) % PRIME
    return ((h * 48271 + 11) % PRIME + 0.5) / dbl(PRIME)


def unit_sql(seed: int, *values: str) -> str:
    """The same as a DuckDB expression; values aren't negative."""
    h = f"{seed % PRIME}::BIGINT"
    for v in values:
        h = f"(({h} * 48271 + ({v})::BIGINT % {PRIME} + 1) % {PRIME})"
        h = f"list_reduce([{h}, 12345, 0, 16807], lambda h, k: (CASE k WHEN 0 THEN h * 69621 + 7 ELSE h * h + k END) % {PRIME})"
    return f"((({h} * 48271 + 11) % {PRIME} + 0.5::DOUBLE) / {PRIME})"


def poisson_cuts(most: int = 12) -> list[float]:
    """P(X <= k) of a Poisson number of mean 1, for k below `most`."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(most):
        total += p
        out.append(total)
        p /= k + 1
    return out


def poisson(u: Column) -> Column:
    weight = F.lit(0)
    for c in poisson_cuts():
        weight = weight + (u >= dbl(c)).cast("int")
    return weight.cast("long")


def weighted_intervals(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, samples: int = S.BOOTSTRAP_SAMPLES, seed: int = S.SEED, by=BY, time: str = "d") -> DataFrame:
    """by, ci_low, ci_high: a 95% interval of the historical VaR. No task holds a series or a sample; days hash the
    same for every series. The mean of a sample's size is the series', so intervals differ from those of equal
    sizes by about one part in its number of rows. Series of fewer than two returns are left out."""
    check(confidence, days)
    by, p = list(by), 1.0 - confidence
    r = stored(returns.where(present("r")).select(*by, F.unix_date(F.col(time).cast("date")).alias("day"), "r"), "returns")
    n = r.groupBy(*by).agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).where("n > 1")
    width = DEVIATIONS
    while True:
        half = F.ceil(F.sqrt(F.col("n") * dbl(p * (1 - p))) * width + 4)
        ranks = n.select(*by, F.explode(F.array(F.greatest(F.floor(F.col("n") * dbl(p)) - half, F.lit(0)), F.least(F.ceil(F.col("n") * dbl(p)) + half, F.col("n") - 1))).alias("rank"))
        edges = order.order_statistics(r, ranks, "r", by).groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        each = r.join(edges, by).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("w", poisson(unit(seed, F.col("sample"), F.col("day")))).where("w > 0")
        below = F.sum(F.when(F.col("r") < F.col("lo"), F.col("w")).otherwise(0))
        sums = each.groupBy(*by, "sample").agg(F.sum("w").alias("total"), below.alias("below"))
        at = (F.col("total") - 1) * dbl(p)
        sums = sums.select(*by, "sample", "below", F.floor(at).alias("k"), F.ceil(at).alias("m"), (at - F.floor(at)).alias("part"))
        inside = each.where((F.col("r") >= F.col("lo")) & (F.col("r") <= F.col("hi"))).groupBy(*by, "sample", "r").agg(F.sum("w").alias("w"))
        inside = inside.join(sums, [*by, "sample"])
        so_far = F.col("below") + F.sum("w").over(W.partitionBy(*by, "sample").orderBy("r").rowsBetween(W.unboundedPreceding, 0))
        inside = inside.withColumn("upto", so_far)
        found = inside.groupBy(*by, "sample").agg(F.min(F.when(F.col("upto") > F.col("k"), F.col("r"))).alias("a"), F.min(F.when(F.col("upto") > F.col("m"), F.col("r"))).alias("b"), F.first("part").alias("part"), F.first("below").alias("below"), F.first("k").alias("k"))
        found = stored(sums.select(*by, "sample").join(found, [*by, "sample"], "left"), "samples")
        # A rank outside the range (which eight deviations make all but impossible): once more, wider.
        if found.where("b IS NULL OR a IS NULL OR k < below").limit(1).count() == 0:
            break
        width *= 4
    q = loss(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    out = found.groupBy(*by).agg(F.percentile(q, dbl(0.025)).alias("ci_low"), F.percentile(q, dbl(0.975)).alias("ci_high"))
    if days > 1:
        out = out.select(*by, *(loss(F.log1p(-F.col(c)) * dbl(math.sqrt(days))).alias(c) for c in ("ci_low", "ci_high")))
    return out


# --- Slices of the seeded stream -------------------------------------------------------------


def _words(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit words start to start + count of the stream of numpy's default generator, which halves 64-bit ones."""
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    return bits.random_raw((start + count + 1) // 2 - start // 2).view(np.uint32)[start % 2 :][:count]


def _rejected(words: np.ndarray, n: int) -> np.ndarray:
    """Whether each word is drawn anew when numbers below n are wanted: those that would make some more likely."""
    return (words.astype(np.uint64) * np.uint64(n)).astype(np.uint32) < np.uint32((2**32 - n) % n)


def draws(seed: int, n: int, first: int, count: int, rejected: np.ndarray) -> np.ndarray:
    """Draws `first` to first + count of integers(0, n), given all rejected positions of the stream, rising."""
    before = np.searchsorted(rejected - np.arange(len(rejected)), first, side="right")
    out, start = [], first + int(before)
    while count > 0:
        words = _words(seed, start, count + 64)
        start += len(words)
        kept = words[~_rejected(words, n)][:count]
        out.append((kept.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64))
        count -= len(kept)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def sliced_paths(returns: DataFrame, paths: int = S.PATHS, days: int = 1, seed: int = S.SEED, by=BY, time: str = "d", slice_paths: int = SLICE_PATHS) -> DataFrame:
    """by, path, total: bit by bit the sums that simulate.draw_paths(x, paths, days, "bootstrap", default_rng(seed))
    gives for a series' returns x in order of time. Each task draws slice_paths paths and has the series' values;
    series of more than 2^32 - 1 values have other draws and are refused."""
    spark = returns.sparkSession
    ship(spark)
    by = list(by)
    r = returns.where(present("r")).select(*by, time, "r")
    series = stored(r.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "r"))), lambda v: v["r"]).alias("x")).where("size(x) > 1"), "series")
    total = paths * days
    span = slice_paths * days
    # Rejections are rare (n in 2^32), but each one moves all later draws.
    reach = total + 64 + total // 1000
    lengths = series.select(F.size("x").cast("long").alias("n")).distinct()
    looked = lengths.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reach - 1).cast("long"), F.lit(span).cast("long"))))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = start + np.flatnonzero(_rejected(_words(seed, start, min(span, reach - start)), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at)], names=["n", "at"])

    lost = looked.repartition("n", "start").mapInArrow(find, "n long, at long").groupBy("n").agg(F.array_sort(F.collect_list("at")).alias("lost"))
    jobs = series.withColumn("n", F.size("x").cast("long")).join(lost, "n", "left").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(slice_paths))))
    key = ", ".join(f"`{c}` {returns.schema[c].dataType.simpleString()}" for c in by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = row.column(len(by)).flatten().to_numpy()
                lost_ = row.column(len(by) + 1)[0].as_py() or []
                first = row.column(len(by) + 2)[0].as_py()
                m = min(slice_paths, paths - first)
                sums = x[draws(seed, len(x), first * days, m * days, np.array(lost_, dtype=np.int64))].reshape(m, days).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.zeros(m, dtype=np.int64))) for c in row.columns[: len(by)]), pa.array(np.arange(first, first + m)), pa.array(sums)], names=[*by, "path", "total"])

    return jobs.select(*by, "x", "lost", "first").repartition(*by, "first").mapInArrow(run, f"{key}, path long, total double")


def sliced_monte_carlo(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, paths: int = S.PATHS, seed: int = S.SEED, by=BY, time: str = "d", slice_paths: int = SLICE_PATHS) -> DataFrame:
    """VaR, ES and standard error of simulate.monte_carlo(draw="bootstrap"), whatever the number of paths: they are
    drawn slice by slice and their order statistics come from nested histograms."""
    check(confidence, days)
    if paths < 100:
        raise ValueError("at least 100 paths are needed")
    by = list(by)
    drawn = stored(sliced_paths(returns, paths, days, seed, by, time, slice_paths).withColumnRenamed("total", "r"), "paths")
    tails = order.long_tail(drawn, confidence, 1, by).select(*by, "var_return", "es_return", F.col("n_observations").alias("paths"), F.col("var_tail_observations").alias("simulated_tail"))
    size = max(paths // S.BATCHES, 100)
    batches = sliced_paths(returns, size * S.BATCHES, days, seed + 1, by, time, slice_paths)
    batches = stored(batches.select(*by, F.floor(F.col("path") / size).alias("batch"), F.col("total").alias("r")), "batches")
    each = order.quantile(batches, 1.0 - confidence, "r", [*by, "batch"])
    error = each.groupBy(*by).agg((F.stddev_samp(loss("q")) / dbl(math.sqrt(S.BATCHES))).alias("standard_error"))
    return tails.join(error, by)
