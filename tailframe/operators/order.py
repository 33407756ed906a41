"""Exact order statistics of series too long for one task.

percentile() and ranking windows bring a series' values together. Here nothing is gathered but
the few values around each wanted rank: values are counted in equal bins (partial counts leave
the map side), the bin that holds the rank becomes the next range, and so on until few values
are left or all of them are equal. Each round is one pass over the values inside the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, loss, over_days, present
from tailframe.plans import settings as S
from tailframe.plans.storage import stored

from .frames import BY
from .tail import check, tail_count, tail_severity

#: Bins of a round, and values of a range that may be sorted in one task.
BINS, ENOUGH, ROUNDS = 4096, 20_000, 40


def order_statistics(values: DataFrame, ranks: DataFrame, value: str = "r", by=BY) -> DataFrame:
    """by, rank, x for each row of ranks (by, rank; 0 is the smallest value)."""
    by = list(by)
    v = values.where(present(value)).select(*by, F.col(value).cast("double").alias("_v"))
    span = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_left"))
    now = ranks.select(*by, "rank").distinct().join(span, by).where("rank >= 0 AND rank < _left").withColumn("_before", F.lit(0).cast("long"))
    for _ in range(ROUNDS):
        now = stored(now, "ranks")  # a row a rank
        open_ = (F.col("_left") > ENOUGH) & (F.col("_lo") < F.col("_hi"))
        if now.where(open_).limit(1).count() == 0:
            break
        # Halves first: hi - lo could overflow.
        width = F.col("_hi") / BINS - F.col("_lo") / BINS
        bin_ = F.when(width > 0, F.least(F.greatest(F.floor(F.col("_v") / width - F.col("_lo") / width), F.lit(0)), F.lit(BINS - 1))).otherwise((F.col("_v") > F.col("_lo")).cast("long"))
        inside = v.join(now.where(open_), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bars = inside.groupBy(*by, "rank", "_before", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        start = F.col("_before") + F.coalesce(F.sum("_n").over(W.partitionBy(*by, "rank").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = bars.withColumn("_start", start).where((F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_n")))
        hit = hit.select(*by, "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_n").alias("_left"), F.col("_start").alias("_before"))
        now = now.where(~open_).unionByName(hit)
    flat = now.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("x"))
    rest = v.join(now.where("_lo < _hi"), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    few = rest.groupBy(*by, "rank", "_before").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    return flat.unionByName(few.select(*by, "rank", F.element_at("_s", (F.col("rank") - F.col("_before") + 1).cast("int")).alias("x")))


def quantile(values: DataFrame, p: float, value: str = "r", by=BY) -> DataFrame:
    """by, n, q: the linearly interpolated quantile, as percentile() gives it."""
    by = list(by)
    n = values.where(present(value)).groupBy(*by).agg(F.count("*").alias("n"))
    at = (F.col("n") - 1) * dbl(p)
    n = n.withColumn("_k", F.floor(at)).withColumn("_part", at - F.floor(at)).withColumn("_m", F.ceil(at))
    ranks = n.select(*by, F.explode(F.array("_k", "_m")).alias("rank"))
    x = order_statistics(values, ranks, value, by)
    low = x.select(*by, F.col("rank").alias("_k"), F.col("x").alias("_low"))
    high = x.select(*by, F.col("rank").alias("_m"), F.col("x").alias("_high"))
    out = n.join(low, [*by, "_k"]).join(high, [*by, "_m"])
    return out.select(*by, "n", (F.col("_low") * (1 - F.col("_part")) + F.col("_high") * F.col("_part")).alias("q"))


def tail_of(values: DataFrame, confidence: float = S.CONFIDENCE, value: str = "r", by=BY) -> DataFrame:
    """by, n, q, k, mean, n_under: the empirical quantile at 1 - confidence, the mean of the k worst values and how many
    are at most q. The mean follows from the k-th worst value and the sum of those below it."""
    by = list(by)
    v = values.where(present(value)).select(*by, F.col(value).cast("double").alias("_r"))
    at = (F.col("n") - 1) * dbl(1.0 - confidence)
    sizes = v.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", F.floor(at).alias("_k"), (at - F.floor(at)).alias("_part"), F.ceil(at).alias("_m"), tail_count("n", confidence).cast("long").alias("k"))
    sizes = stored(sizes, "sizes")  # a row a group, as are the edges
    ranks = sizes.select(*by, F.explode(F.array("_k", "_m", F.col("k") - 1)).alias("rank"))
    x = order_statistics(v, ranks, "_r", by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_xs"))
    of = lambda rank: F.element_at("_xs", rank)
    q = of(F.col("_k")) * (1 - F.col("_part")) + of(F.col("_m")) * F.col("_part")
    edges = stored(sizes.join(x, by).select(*by, "n", "k", q.alias("q"), of(F.col("k") - 1).alias("_x")), "edges")
    below = v.join(edges, by).groupBy(*by, "n", "q", "k", "_x").agg(
        F.coalesce(F.sum(F.when(F.col("_r") < F.col("_x"), F.col("_r"))), dbl(0)).alias("_sum"), F.count_if(F.col("_r") < F.col("_x")).alias("_under"), F.count_if(F.col("_r") <= F.col("q")).alias("n_under")
    )
    mean = (F.col("_sum") + (F.col("k") - F.col("_under")) * F.col("_x")) / F.col("k")
    return below.select(*by, "n", "q", "k", mean.alias("mean"), "n_under")


def long_tail(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, by=BY) -> DataFrame:
    """VaR and ES of series of any length, equal to historical_var() and historical_es()."""
    check(confidence, days)
    t = tail_of(returns, confidence, "r", by).where("n >= 2")
    var, es = loss(over_days("q", days)), loss(over_days("mean", days))
    return t.select(*by, var.alias("var_return"), es.alias("es_return"), tail_severity(var, es).alias("tail_severity"), F.col("n").alias("n_observations"), F.col("k").alias("tail_observations"), F.col("n_under").alias("var_tail_observations"))
