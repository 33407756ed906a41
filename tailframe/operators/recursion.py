"""The variance recursion of GARCH(1,1) over series too long for one task.

v(t + 1) = omega + alpha e(t)^2 + beta v(t) is an affine map of v(t), and affine maps compose: a part of a series
maps the variance it starts with to the one it ends with by two numbers. So a first pass gives each part's
map, the maps of the parts before a part give its start, and a second pass fills it in. What a day's variance does
to the likelihood of all later days is the same kind of map, run backwards, so the slope is a sum over parts too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, present
from tailframe.plans import settings as S
from tailframe.plans.shipping import ship
from tailframe.plans.storage import stored

from .blocks import PART_ROWS, Parts
from .fit import STARTS, _start, _t_constant, decayed_sums, search_garch
from .frames import BY

SCALE = S.GARCH_SCALE


def long_variances(returns: DataFrame, parameters: DataFrame, by=BY, time: str = "d", part_rows: int = PART_ROWS) -> DataFrame:
    """by, time, shock, variance, annualised: the conditional variance of each day (percent squared) before its shock
    is known. parameters: by, mean (percent), omega, alpha, beta, first_variance. Series without parameters are
    left out."""
    ship(returns.sparkSession)
    by = list(by)
    parts = Parts.of(returns.where(present("r")).select(*by, time, "r"), by, time, part_rows)
    rows = parts.rows.join(parameters.select(*by, "mean", "omega", "alpha", "beta", "first_variance"), by)
    e = F.col("r") * SCALE - F.col("mean")
    rows = rows.withColumn("shock", e).withColumn("u", F.col("omega") + F.col("alpha") * e * e)
    at = [*by, "_part"]
    kind = lambda c: rows.schema[c].dataType.simpleString()
    keys = ", ".join(f"`{c}` {kind(c)}" for c in at)
    n = len(at)

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        u, beta = table.column("u").to_numpy(), table.column("beta")[0].as_py()
        return pa.table([*(table.column(c).slice(0, 1) for c in at), pa.array([float(decayed_sums(u, beta)[-1])]), pa.array([float(beta ** len(u))])], names=[*at, "add", "times"])

    maps = rows.select(*at, time, "u", "beta").groupBy(*at).applyInArrow(ends, f"{keys}, add double, times double")
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    maps = maps.select(*at, F.collect_list(F.struct("add", "times")).over(earlier).alias("maps"))
    start = F.aggregate("maps", F.col("first_variance"), lambda v, m: m["add"] + m["times"] * v)
    begun = rows.join(maps, at).withColumn("start", start).select(*at, time, "shock", "u", "beta", "start")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by(time)
        u = table.column("u").to_numpy().copy()
        v = decayed_sums(np.concatenate([[table.column("start")[0].as_py()], u[:-1]]), table.column("beta")[0].as_py())
        return table.select([*at[: n - 1], time, "shock"]).append_column("variance", pa.array(v))

    filled = begun.groupBy(*at).applyInArrow(fill, ", ".join(f"`{c}` {kind(c)}" for c in (*by, time, "shock")) + ", variance double")
    return filled.withColumn("annualised", F.sqrt("variance") / SCALE * dbl(math.sqrt(S.TRADING_DAYS)))


def long_log_likelihood(variances: DataFrame, by=BY) -> DataFrame:
    """by, log_likelihood, n: of normal shocks; sums over parts."""
    one = -0.5 * (dbl(math.log(2 * math.pi)) + F.ln("variance") + F.col("shock") * F.col("shock") / F.col("variance"))
    return variances.groupBy(*by).agg(F.sum(one).alias("log_likelihood"), F.count("*").alias("n"))


class LongSeries:
    """One series as stored parts, each a row with its values in order (percent). likelihood() is two passes
    whose results are a few numbers a part."""

    def __init__(self, returns: DataFrame, time: str = "d", part_rows: int = PART_ROWS):
        self.spark = returns.sparkSession
        ship(self.spark)
        r = returns.where(present("r"))
        parts = Parts.of(r.select(F.lit(0).alias("one"), time, (F.col("r") * SCALE).alias("x")), ("one",), time, part_rows)
        packed = parts.rows.groupBy("_part").agg(F.transform(F.array_sort(F.collect_list(F.struct(time, "x"))), lambda v: v["x"]).alias("x"))
        tasks = parts.rows.select("_part").distinct().count()
        self.parts = stored(packed.repartition(max(1, tasks), "_part"), "series")
        sums = self.parts.select(F.explode("x").alias("x")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")).first()
        self.n, self.mean, self.var = sums.n, sums.mean or 0.0, max(sums.var or 0.0, 1e-12)
        self.order = [row["_part"] for row in self.parts.select("_part").orderBy("_part").collect()]
        # The first 75 values, which the first variance is made of, may cross parts.
        held: list[float] = []
        for k in self.order:
            if len(held) < 75:
                held += self.parts.where(F.col("_part") == k).select(F.slice("x", 1, 75).alias("x")).first().x
        self.first = np.array(held[:75])

    def _each(self, compute, schema: str) -> dict[int, list[float]]:
        def run(batches):
            for batch in batches:
                for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([compute(part, x.values.to_numpy())], pa.list_(pa.float64()))], names=["part", "out"])

        return {r["part"]: r["out"] for r in self.parts.select("_part", "x").mapInArrow(run, schema).collect()}

    def likelihood(self, p: tuple[float, ...]) -> tuple[float, np.ndarray | None]:
        """The likelihood of fit.garch_likelihood() and its slope."""
        mu, omega, alpha, beta, *nu = p
        schema = "part int, out array<double>"

        def ends(_, x):
            u = omega + alpha * (x - mu) ** 2
            return [float(decayed_sums(u, beta)[-1]), float(beta ** len(u))]

        maps = self._each(ends, schema)
        e = self.first - mu
        start, w = _start(e * e)
        now, begin = omega + (alpha + beta) * start, {}
        for k in self.order:
            begin[k] = now
            now = maps[k][0] + maps[k][1] * now

        def sums(part, x):
            e = x - mu
            e2 = e * e
            u = omega + alpha * e2
            s2 = decayed_sums(np.concatenate([[begin[part]], u[:-1]]), beta)
            if not np.isfinite(s2).all() or s2.min() <= 0:
                return [-math.inf] + [0.0] * 13
            z2 = e2 / s2
            if nu:
                v = nu[0]
                value = -float((0.5 * np.log(s2) + (v + 1) / 2 * np.log1p(z2 / (v - 2))).sum())
                pull = (v + 1) / (v - 2 + z2)
                by_nu = -0.5 * float(np.log1p(z2 / (v - 2)).sum()) + 0.5 * (v + 1) / (v - 2) * float((z2 / (v - 2 + z2)).sum())
            else:
                value, pull, by_nu = -0.5 * float((math.log(2 * math.pi) + np.log(s2) + z2).sum()), 1.0, 0.0
            later = decayed_sums((0.5 * (pull * z2 - 1.0) / s2)[::-1], beta)[::-1]
            after = np.concatenate([later[1:], [0.0]])  # of the day after each, as far as this part knows
            decay = beta ** np.arange(len(x) - 1, -1, -1.0)  # times what comes after this part
            effects = np.stack([np.ones_like(e), e2, s2, -2 * alpha * e])
            return [value, by_nu, float((pull * e / s2).sum()), float(later[0]), float(beta ** len(x)), float(len(x)), *(effects @ after).tolist(), *(effects @ decay).tolist()]

        got = self._each(sums, schema)
        value, by_nu, by_mu, total, beyond = 0.0, 0.0, 0.0, np.zeros(4), 0.0
        for k in reversed(self.order):
            out = got[k]
            if not math.isfinite(out[0]):
                return -math.inf, None
            value, by_nu, by_mu = value + out[0], by_nu + out[1], by_mu + out[2]
            total += np.array(out[6:10]) + beyond * np.array(out[10:14])
            beyond = out[3] + out[4] * beyond
        if nu:
            h = 1e-5 * nu[0]
            value += self.n * _t_constant(nu[0])
            by_nu += self.n * (_t_constant(nu[0] + h) - _t_constant(nu[0] - h)) / (2 * h)
        by_mu += total[3] - 2 * beyond * (alpha + beta) * float(w @ e[: len(w)])
        slope = [by_mu, total[0] + beyond, total[1] + beyond * start, total[2] + beyond * start, *([by_nu] if nu else [])]
        return value, np.array(slope)


def fit_long_garch(returns: DataFrame, distribution: str = "t", starts=STARTS, time: str = "d", part_rows: int = PART_ROWS) -> dict:
    """fit.fit_garch() of one series of any length: the same search, each of whose steps is two passes over stored
    parts. Of the starts, the search goes on from the likeliest alone. returns: time, r of one series."""
    if distribution not in ("t", "normal"):
        raise ValueError(f"unknown distribution: {distribution!r}")
    series = LongSeries(returns, time, part_rows)
    if series.n < S.GARCH_MIN:
        raise ValueError(f"fewer than {S.GARCH_MIN} returns")

    def at(start: tuple[float, float]) -> float:
        total, share = start
        return series.likelihood((series.mean, series.var * (1 - total), total * share, total * (1 - share), *([8.05] if distribution == "t" else [])))[0]

    likeliest = max(starts, key=at)
    p, value, converged = search_garch(series.likelihood, series.n, series.mean, series.var, distribution, (likeliest,))
    mu, omega, alpha, beta, *nu = p
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "nu": nu[0] if nu else None, "log_likelihood": -value, "aic": 2 * value + 2 * len(p), "bic": 2 * value + len(p) * math.log(series.n), "converged": converged, "n_observations": series.n}
