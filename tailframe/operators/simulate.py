"""Simulation: bootstrap intervals, Monte-Carlo VaR and ES, convergence.

Two engines. The seeded one draws with numpy inside one task a series, so a seed gives the same
numbers everywhere. The hashed one draws by hashing (seed, path, day), so paths of one series
spread over any number of tasks and don't depend on the partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailframe.functions.columns import dbl, loss, present
from tailframe.plans import settings as S

from . import order
from .fit import _keys, _schema, degrees_of_freedom, fit_t
from .draws import unit as portable_unit
from .frames import BY, ordered
from .tail import check, tail_count, tail_severity

DRAWS = ("bootstrap", "normal", "t")


def _loss(x):
    return -(np.exp(x) - 1.0)


def draw_paths(x: np.ndarray, paths: int, days: int, draw: str, rng: np.random.Generator, dof: float | None = None) -> np.ndarray:
    """Sums of `days` draws, which are the log returns over the horizon."""
    if len(x) < 2:
        raise ValueError("fewer than two returns")
    mu, sd = float(np.mean(x)), float(np.std(x, ddof=1))
    if draw == "bootstrap":
        return rng.choice(x, size=(paths, days), replace=True).sum(axis=1)
    if draw == "normal":
        return rng.normal(mu, sd, size=(paths, days)).sum(axis=1)
    if draw == "t":
        if dof is None:
            raise ValueError("degrees of freedom are needed")
        return (mu + rng.standard_t(dof, size=(paths, days)) * math.sqrt((dof - 2) / dof) * sd).sum(axis=1)
    raise ValueError(f"unknown draw: {draw!r}")


def k_worst(x: np.ndarray, confidence: float) -> np.ndarray:
    k = max(1, math.ceil(round(len(x) * (1.0 - confidence), 9)))
    return np.sort(x)[:k]


def bootstrap_interval(x: np.ndarray, confidence: float, days: int = 1, samples: int = S.BOOTSTRAP_SAMPLES, seed: int = S.SEED) -> tuple[float, float]:
    """A 95% interval of the VaR by resampling. Samples are drawn in blocks of one stream, so that
    memory is bounded and the numbers are those of one draw."""
    rng, n, level = np.random.default_rng(seed), len(x), 1.0 - confidence
    block = max(1, 4_000_000 // max(n, 1))
    q = np.concatenate([np.quantile(rng.choice(x, size=(min(block, samples - k), n), replace=True), level, axis=1) for k in range(0, samples, block)])
    low, high = np.percentile(_loss(q), [2.5, 97.5])
    if days > 1:
        low, high = (_loss(np.log1p(-v) * math.sqrt(days)) for v in (low, high))
    return float(low), float(high)


def var_intervals(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, samples: int = S.BOOTSTRAP_SAMPLES, seed: int = S.SEED, by=BY, time: str = "d") -> DataFrame:
    check(confidence, days)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)["r"].to_numpy(dtype=float)
        low, high = bootstrap_interval(x, confidence, days, samples, seed) if len(x) > 1 else (np.nan, np.nan)
        return pd.DataFrame([{**_keys(pdf, by), "ci_low": low, "ci_high": high}])

    r = returns.where(present("r")).select(*by, time, "r")
    return r.groupBy(*by).applyInPandas(one, f"{_schema(r, by)}, ci_low double, ci_high double")


def monte_carlo(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, paths: int = S.PATHS, draw: str = "bootstrap", seed: int = S.SEED, by=BY, time: str = "d") -> DataFrame:
    """Simulated VaR and ES of each series with the standard error of ten batches. The worst observed
    loss scales with the horizon itself here, not with its root."""
    check(confidence, days)
    if paths < 100:
        raise ValueError("at least 100 paths are needed")
    if draw not in DRAWS:
        raise ValueError(f"unknown draw: {draw!r}")
    level = 1.0 - confidence

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)["r"].to_numpy(dtype=float)
        if len(x) < 2:
            return pd.DataFrame(columns=[*by, "x"]).iloc[:0].reindex(columns=names)
        dof = float(np.clip(fit_t(x)[0], *S.DOF_RANGE)) if draw == "t" else None
        sim = draw_paths(x, paths, days, draw, np.random.default_rng(seed), dof)
        q = float(np.quantile(sim, level))
        rng, size = np.random.default_rng(seed + 1), max(paths // S.BATCHES, 100)
        batches = [float(_loss(np.quantile(draw_paths(x, size, days, draw, rng, dof), level))) for _ in range(S.BATCHES)]
        var, es = float(_loss(q)), float(_loss(k_worst(sim, confidence).mean()))
        row = [var, es, float(np.std(batches, ddof=1) / math.sqrt(S.BATCHES)), int((sim <= q).sum()), float(_loss(sim).max()), float(_loss(x.min() * days)), dof, len(x)]
        return pd.DataFrame([[*_keys(pdf, by).values(), *row]], columns=names).astype({"dof": "float64"})

    r = returns.where(present("r")).select(*by, time, "r")
    names = [*by, "var_return", "es_return", "standard_error", "simulated_tail", "worst_simulated_loss", "worst_observed_loss", "dof", "n_observations"]
    out = r.groupBy(*by).applyInPandas(one, f"{_schema(r, by)}, var_return double, es_return double, standard_error double, simulated_tail long, worst_simulated_loss double, worst_observed_loss double, dof double, n_observations long")
    value = (lambda c: F.col(c) * dbl(portfolio_value)) if portfolio_value is not None else (lambda c: F.lit(None).cast("double"))
    out = out.withColumns({"method": F.lit(f"monte-carlo-{draw}"), "confidence": dbl(confidence), "horizon_days": F.lit(days), "paths": F.lit(paths), "var_value": value("var_return"), "es_value": value("es_return")})
    out = out.withColumn("tail_severity", tail_severity(F.col("var_return"), F.col("es_return"))).withColumn("exceeds_history", F.col("worst_simulated_loss") > F.col("worst_observed_loss"))
    return out.withColumn("few_tail_paths", F.col("simulated_tail") < S.MIN_SIMULATED_TAIL)


def convergence(returns: DataFrame, sizes=(500, 1000, 2500, 5000, 10_000, 25_000, 50_000), confidence: float = S.CONFIDENCE, days: int = 1, draw: str = "bootstrap", seed: int = S.SEED, by=BY, time: str = "d") -> DataFrame:
    """VaR by number of paths, each from the same seed, and its change from the size before."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)["r"].to_numpy(dtype=float)
        dof = float(np.clip(fit_t(x)[0], *S.DOF_RANGE)) if draw == "t" else None
        v = [float(_loss(np.quantile(draw_paths(x, n, days, draw, np.random.default_rng(seed), dof), 1.0 - confidence))) for n in sizes]
        return pd.DataFrame({**{c: [k] * len(sizes) for c, k in _keys(pdf, by).items()}, "paths": sizes, "var_return": v, "step": [np.nan, *np.abs(np.diff(v))]})

    r = returns.where(present("r")).select(*by, time, "r")
    return r.groupBy(*by).applyInPandas(one, f"{_schema(r, by)}, paths long, var_return double, step double")


def hashed_paths(returns: DataFrame, paths: int = S.PATHS, days: int = 1, draw: str = "bootstrap", seed: int = S.SEED, by=BY, portable: bool = False) -> DataFrame:
    """by, path, total: simulated log returns, drawn in the JVM, by xxhash64 or (portable) by the integer hash of
    draws.unit(), which other engines can repeat. Each series' values travel once, as
    an array, and are then exploded into paths; nothing depends on the order of rows. Student-t
    draws use the fitted degrees of freedom and Bailey's polar form of two uniforms, scaled to
    the deviation of the series; series of fewer than eight returns have none."""
    if draw not in DRAWS:
        raise ValueError(f"unknown draw: {draw!r}")
    r = returns.where(present("r"))
    s = r.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("x"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd")).where(F.size("x") > 1)
    if draw == "t":
        s = s.join(degrees_of_freedom(returns, by).where("dof IS NOT NULL"), list(by))
    s = s.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    spread = lambda salt, day: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("path"), day), F.lit(1 << 52)).cast("double") + 0.5) / dbl(1 << 52)
    unit = (lambda salt, day: portable_unit(seed, F.lit(salt), F.col("path"), day)) if portable else spread
    if draw == "bootstrap":
        one = lambda day: F.element_at("x", (F.floor(unit(0, day) * F.size("x")) + 1).cast("int"))
    elif draw == "t":
        v = F.col("dof")
        radius = lambda day: F.sqrt(v * (F.pow(unit(1, day), -2 / v) - 1))
        one = lambda day: F.col("m") + F.col("sd") * F.sqrt((v - 2) / v) * radius(day) * F.cos(unit(2, day) * dbl(2 * math.pi))
    else:
        one = lambda day: F.col("m") + F.col("sd") * F.sqrt(-2 * F.ln(unit(1, day))) * F.cos(unit(2, day) * dbl(2 * math.pi))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(days)), one), dbl(0), lambda a, v: a + v)
    return s.select(*by, "path", total.alias("total"))


def hashed_monte_carlo(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, paths: int = S.PATHS, draw: str = "bootstrap", seed: int = S.SEED, by=BY, portable: bool = False) -> DataFrame:
    """VaR and standard error of the hashed engine. Batches are slices of the paths."""
    check(confidence, days)
    p = hashed_paths(returns, paths, days, draw, seed, by, portable).withColumn("batch", F.pmod("path", F.lit(S.BATCHES)))
    level = dbl(1.0 - confidence)
    whole = p.groupBy(*by).agg(loss(F.percentile("total", level)).alias("var_return"), loss(F.min("total")).alias("worst_simulated_loss"))
    each = p.groupBy(*by, "batch").agg(loss(F.percentile("total", level)).alias("v"))
    error = each.groupBy(*by).agg((F.stddev_samp("v") / dbl(math.sqrt(S.BATCHES))).alias("standard_error"))
    return whole.join(error, list(by))


def hashed_convergence(returns: DataFrame, sizes=(500, 1000, 2500, 5000, 10_000, 25_000, 50_000), confidence: float = S.CONFIDENCE, days: int = 1, draw: str = "bootstrap", seed: int = S.SEED, by=BY, portable: bool = False) -> DataFrame:
    """convergence() of the hashed engine: the paths of a size are the first ones, so one set serves all sizes."""
    p = hashed_paths(returns, max(sizes), days, draw, seed, by, portable)
    of = p.withColumn("paths", F.explode(F.filter(F.array(*(F.lit(n).cast("long") for n in sizes)), lambda n: F.col("path") < n)))
    v = of.groupBy(*by, "paths").agg(loss(F.percentile("total", dbl(1.0 - confidence))).alias("var_return"))
    before = F.lag("var_return").over(ordered(by, "paths"))
    return v.withColumn("step", F.abs(F.col("var_return") - before))


def subadditivity_demo(n: int = 100_000, seed: int = 1234, confidence: float = 0.95) -> dict:
    """Two independent positions that each lose all with probability 4%: the VaR of the sum exceeds
    the sum of the VaRs, the expected shortfall doesn't."""
    rng = np.random.default_rng(seed)
    a, b = (np.where(rng.random(n) < 0.04, -1.0, 0.02) for _ in range(2))
    both = (a + b) / 2
    var = [-float(np.quantile(v, 1.0 - confidence)) for v in (a, b, both)]
    es = [-float(k_worst(v, confidence).mean()) for v in (a, b, both)]
    return {"var_a": var[0], "var_b": var[1], "var_sum": var[2], "es_a": es[0], "es_b": es[1], "es_sum": es[2], "var_is_subadditive": var[2] <= var[0] + var[1], "es_is_subadditive": es[2] <= es[0] + es[1]}


def subadditivity(positions: DataFrame, confidence: float = S.CONFIDENCE, by=("book",)) -> DataFrame:
    """positions: by, a, b, the outcomes of two positions in each scenario. Of each book: the VaR of
    a, b and the equally weighted book ("sum") by the empirical quantile and the ES by the k worst, and
    whether the book's is at most the sum of its parts'."""
    # The keys as one struct: joins by it keep groups whose key is NULL. Books may be of any length.
    long = positions.select(F.struct(*by).alias("_key"), F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"), F.lit("sum"), (F.col("a") + F.col("b")) / 2)).alias("position", "r"))
    one = order.tail_of(long, confidence, "r", ["_key", "position"]).select("_key", "position", (-F.col("q")).alias("var"), (-F.col("mean")).alias("es"))
    out = one.groupBy("_key").pivot("position", ["a", "b", "sum"]).agg(F.first("var").alias("var"), F.first("es").alias("es")).select("_key.*", "*").drop("_key")
    out = out.select(*by, *(F.col(f"{p}_{m}").alias(f"{m}_{p}") for m in ("var", "es") for p in ("a", "b", "sum")))
    fits = lambda m: (F.col(f"{m}_sum") <= F.col(f"{m}_a") + F.col(f"{m}_b") + 1e-12).alias(f"{m}_is_subadditive")
    return out.select("*", fits("var"), fits("es"))


def compare_methods(returns: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, paths: int = 20_000, by=BY) -> DataFrame:
    """Five estimates a series: empirical, normal, Student-t, and two simulations."""
    from .tail import historical_es, parametric_var

    columns = [*by, "method", F.col("var_return").alias("var"), F.col("es_return").alias("es"), "tail_severity", "es_value"]
    parts = [historical_es(returns, confidence, days, portfolio_value, by).select(*columns)]
    parts += [parametric_var(returns, confidence, days, portfolio_value, d, by=by).select(*columns) for d in ("normal", "t")]
    parts += [monte_carlo(returns, confidence, days, portfolio_value, paths, d, by=by).select(*columns) for d in ("bootstrap", "t")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = out.where("method = 'historical'").select(*by, F.col("var").alias("_h"))
    return out.join(first, list(by), "left").withColumn("var_vs_historical", F.col("var") - F.col("_h")).drop("_h")


__all__ = ["bootstrap_interval", "compare_methods", "convergence", "draw_paths", "hashed_monte_carlo", "hashed_paths", "k_worst", "monte_carlo", "subadditivity", "subadditivity_demo", "tail_count", "var_intervals"]
