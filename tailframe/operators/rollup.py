"""Tail quantiles over roll-ups, by a sketch that merges.

Exact percentiles of a series, its nation, its region and everything would each need their rows together again. The
sketch counts values in buckets whose bounds grow by a factor, so that the middle of a bucket is within
`error` of any value in it. Counts add up: they are made once by series, in the map side's partial aggregates,
and only the counts go up the roll-up. A sketch has a few thousand buckets, whatever it has counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, loss, present
from tailframe.plans import settings as S
from tailframe.plans.storage import stored

from .tail import check

#: Relative error of a quantile; values nearer to 0 than NOTHING are one bucket; OFFSET keeps the signs apart.
ERROR, NOTHING, OFFSET = 0.005, 1e-12, 1_000_000


def growth(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The number of a value's bucket; numbers rise with values."""
    place = F.ceil(F.ln(F.abs(value)) / dbl(math.log(growth(error)))).cast("long") + OFFSET
    return F.when(F.abs(value) < NOTHING, F.lit(0).cast("long")).when(value > 0, place).otherwise(-place)


def middle(number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    g = growth(error)
    size = F.exp((F.abs(number) - OFFSET) * dbl(math.log(g))) * dbl(2 / (1 + g))
    return F.when(number == 0, dbl(0)).when(number > 0, size).otherwise(-size)


def sketches(returns: DataFrame, by: list[str], error: float = ERROR) -> DataFrame:
    """by, bucket, n."""
    return returns.where(present("r")).groupBy(*by, bucket(F.col("r"), error).alias("bucket")).agg(F.count("*").alias("n"))


def rollup_var(returns: DataFrame, levels: list[str], confidence: float = S.CONFIDENCE, error: float = ERROR) -> DataFrame:
    """levels (NULL where rolled up), level (how many are given), n_observations, quantile, var_return: of every
    combination of levels from all of them to none. quantile is within `error`, relatively, of the exact lower
    order statistic at rank floor((n - 1)(1 - confidence)). levels mustn't be NULL in the input."""
    check(confidence)
    counts = sketches(returns, levels, error)
    # The finest level's counts are sums already; each level above adds up those of the one below it, which are few.
    parts, types = [], [(c, counts.schema[c].dataType.simpleString()) for c in levels]
    for level in range(len(levels), -1, -1):
        if level < len(levels):
            counts = counts.groupBy(*levels[:level], "bucket").agg(F.sum("n").alias("n"))
        if level >= len(levels) - 1:
            counts = stored(counts, "counts")
        parts.append(_quantiles(counts, levels, level, types[level:], confidence, error))
    out = parts[-1]
    for part in parts[-2::-1]:
        out = out.unionByName(part)
    return out


def _quantiles(counts: DataFrame, levels: list[str], level: int, absent: list[tuple[str, str]], confidence: float, error: float) -> DataFrame:
    """The rows of one level from its counts (levels[:level], bucket, n); absent: the names and types of the other levels."""
    by = levels[:level]
    group = W.partitionBy(*by)
    if by and not absent:
        # The finest level has nearly as many buckets as values; with a given number of parts they aren't merged into few large ones.
        counts = counts.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    rolled = counts.withColumn("_upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("n_observations", F.sum("n").over(group))
    rank = F.floor((F.col("n_observations") - 1) * dbl(1.0 - confidence))
    found = rolled.where(F.col("_upto") > rank).groupBy(*by).agg(F.first("n_observations").alias("n_observations"), F.min("bucket").alias("_bucket"))
    q = middle(F.col("_bucket"), error)
    found = found.where("n_observations IS NOT NULL")  # without a key there is a row even of no input
    rest = (F.lit(None).cast(counts_type).alias(c) for c, counts_type in absent)
    return found.select(F.lit(level).alias("level"), *by, *rest, "n_observations", q.alias("quantile"), loss(q).alias("var_return"))
