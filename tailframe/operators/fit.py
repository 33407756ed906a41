"""Iterative fits, one series to a task: Student-t, ARCH-LM, GARCH(1,1) and its VaR.

The likelihoods need sequential state or iteration, which no window frame expresses; each
series is one Arrow group, and refits of a rolling model are groups of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailframe.functions import specfun
from tailframe.functions.columns import conditional_regime, dbl, loss, messages, normal_quantile, present
from tailframe.functions.distributions import t_quantile
from tailframe.plans import settings as S
from tailframe.plans.shipping import ship

from .frames import BY
from .tail import check

SCALE = S.GARCH_SCALE


# --- Student-t ---------------------------------------------------------------------------


def t_location_scale(x: np.ndarray, v: float, rounds: int = 200) -> tuple[float, float, float]:
    """Location, scale and log-likelihood at fixed degrees of freedom: reweighted means, where a
    value's weight falls with its distance."""
    mu, s2 = float(np.median(x)), float(np.var(x)) or 1e-300
    for _ in range(rounds):
        w = (v + 1) / (v + (x - mu) ** 2 / s2)
        new_mu = float((w * x).sum() / w.sum())
        new_s2 = float((w * (x - new_mu) ** 2).mean()) or 1e-300
        done = abs(new_mu - mu) <= 1e-12 * math.sqrt(new_s2) and abs(new_s2 - s2) <= 1e-12 * new_s2
        mu, s2 = new_mu, new_s2
        if done:
            break
    each = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi * s2)
    return mu, math.sqrt(s2), len(x) * each - (v + 1) / 2 * float(np.log1p((x - mu) ** 2 / (s2 * v)).sum())


def fit_t(x: np.ndarray) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale of largest likelihood: golden section over ln v."""
    value = lambda u: -t_location_scale(x, math.exp(u))[2]
    a, b, g = math.log(0.3), math.log(1e4), (math.sqrt(5) - 1) / 2
    grid = np.linspace(a, b, 24)
    k = int(np.argmin([value(u) for u in grid]))
    a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = value(c), value(d)
    while b - a > 1e-7:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = value(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = value(d)
    v = math.exp((a + b) / 2)
    mu, s, _ = t_location_scale(x, v)
    return v, mu, s


def _schema(df: DataFrame, by) -> str:
    ship(df.sparkSession)  # every Python group function here asks for its key columns first
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def _keys(pdf: pd.DataFrame, by) -> dict:
    return {c: pdf[c].iloc[0] for c in by}


def degrees_of_freedom(returns: DataFrame, by=BY) -> DataFrame:
    """by, dof: the fitted degrees of freedom, clipped after the fit."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["r"].to_numpy(dtype=float)
        v = float(np.clip(fit_t(x)[0], *S.DOF_RANGE)) if len(x) >= 8 else None
        return pd.DataFrame([{**_keys(pdf, by), "dof": v}])

    return returns.where(present("r")).select(*by, "r").groupBy(*by).applyInPandas(one, f"{_schema(returns, by)}, dof double")


# --- ARCH-LM and GARCH ---------------------------------------------------------------------


def arch_lm(residuals: np.ndarray, lags: int = S.ARCH_LAGS) -> tuple[float, float]:
    """Statistic (n times the R-squared of squares on their lags) and p-value."""
    e2 = np.asarray(residuals, dtype=float) ** 2
    if len(e2) <= lags + 1:
        raise ValueError(f"more than {lags + 1} values are needed for {lags} lags")
    y = e2[lags:]
    x = np.stack([np.ones_like(y), *(e2[lags - k : len(e2) - k] for k in range(1, lags + 1))], axis=1)
    rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    total = float(((y - y.mean()) ** 2).sum())
    stat = len(y) * (1.0 - float((rest**2).sum()) / total) if total > 0 else 0.0
    return stat, chi2_tail(stat, lags)


def chi2_tail(x: float, df: int) -> float:
    if df % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2)) if x > 0 else 1.0
    if x <= 0:
        return 1.0
    # Odd: from one degree of freedom upwards, each step adds a term.
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, df, 2):
        out += term
        term *= x / (k + 2)
    return out


def decayed_sums(u: np.ndarray, beta: float) -> np.ndarray:
    """y with y[t] = u[t] + beta * y[t - 1], by doubling: each pass takes in the sums that end twice as far back."""
    y, reach, weight = u.copy(), 1, beta
    while reach < len(y) and weight > 1e-18:
        y[reach:] += weight * y[:-reach]
        reach, weight = 2 * reach, weight * weight
    return y


def _start(e2: np.ndarray) -> tuple[float, np.ndarray]:
    """The variance before the first day, an exponentially weighted mean of the first 75 squares, and the weights."""
    w = 0.94 ** np.arange(min(75, len(e2)))
    w /= w.sum()
    return float(e2[: len(w)] @ w), w


def variances(e: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    e2 = e * e
    u = np.empty_like(e2)
    u[0] = omega + (alpha + beta) * _start(e2)[0]
    u[1:] = omega + alpha * e2[:-1]
    return decayed_sums(u, beta)


def _t_constant(v: float) -> float:
    return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2))


def garch_likelihood(x: np.ndarray, p: tuple[float, ...]) -> float:
    mu, omega, alpha, beta, *nu = p
    e = x - mu
    s2 = variances(e, omega, alpha, beta)
    if not np.isfinite(s2).all() or s2.min() <= 0:
        return -math.inf
    z2 = e * e / s2
    if not nu:
        return -0.5 * float((math.log(2 * math.pi) + np.log(s2) + z2).sum())
    v = nu[0]
    return len(x) * _t_constant(v) - float((0.5 * np.log(s2) + (v + 1) / 2 * np.log1p(z2 / (v - 2))).sum())


def garch_slope(x: np.ndarray, p: tuple[float, ...]) -> np.ndarray:
    """Derivatives of the likelihood by the parameters. What a day's variance does to all later ones is
    summed from the last day back, so one pass serves all parameters."""
    mu, omega, alpha, beta, *nu = p
    e = x - mu
    e2, s2 = e * e, variances(e, omega, alpha, beta)
    z2 = e2 / s2
    if nu:
        v = nu[0]
        pull = (v + 1) / (v - 2 + z2)  # how much an outlier counts; 1 for normal shocks
        h = 1e-5 * v
        by_nu = len(x) * (_t_constant(v + h) - _t_constant(v - h)) / (2 * h) - 0.5 * float(np.log1p(z2 / (v - 2)).sum()) + 0.5 * (v + 1) / (v - 2) * float((z2 / (v - 2 + z2)).sum())
    else:
        pull = 1.0
    later = decayed_sums((0.5 * (pull * z2 - 1.0) / s2)[::-1], beta)[::-1]
    start, w = _start(e2)
    by_mu = float((pull * e / s2).sum()) - 2 * alpha * float(later[1:] @ e[:-1]) - 2 * later[0] * (alpha + beta) * float(w @ e[: len(w)])
    by_alpha = float(later[1:] @ e2[:-1]) + later[0] * start
    by_beta = float(later[1:] @ s2[:-1]) + later[0] * start
    return np.array([by_mu, float(later.sum()), by_alpha, by_beta, *([by_nu] if nu else [])])


def quasi_newton(f, start: np.ndarray, rounds: int = 300, tolerance: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """BFGS minimisation with step halving; f gives the value and its gradient."""
    u, (value, g) = start, f(start)
    inverse = np.eye(len(u))
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            return u, value, True
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(len(u)), -g
        way *= min(1.0, 2.0 / np.abs(way).max())
        size = 1.0
        while size > 1e-10:
            new, slope = f(u + size * way)
            if new <= value + 1e-4 * size * (way @ g):
                break
            size /= 2
        else:
            if (inverse == np.eye(len(u))).all():
                return u, value, bool(np.abs(g).max() < 1e-4)
            inverse = np.eye(len(u))
            continue
        step, turn = size * way, slope - g
        u, value, g = u + step, new, slope
        if (curve := step @ turn) > 1e-14:
            side = np.eye(len(u)) - np.outer(step, turn) / curve
            inverse = side @ inverse @ side.T + np.outer(step, step) / curve
    return u, value, False


def likelihood_and_slope(x: np.ndarray, p: tuple[float, ...]) -> tuple[float, np.ndarray | None]:
    value = garch_likelihood(x, p)
    return value, garch_slope(x, p) if math.isfinite(value) else None


#: Where searches start: persistence and alpha's share of it.
STARTS = ((0.95, 0.1), (0.98, 0.06), (0.8, 0.2), (0.995, 0.01))


def search_garch(evaluate, n: int, mean: float, var: float, distribution: str, starts=STARTS) -> tuple[tuple[float, ...], float, bool]:
    """Parameters of largest likelihood, minus that, and whether the search settled. evaluate(parameters): the
    likelihood and its slope. The search runs on free coordinates: ln omega relative to the variance, the logits of
    persistence and of alpha's share, ln(nu - 2.05)."""
    sd = math.sqrt(var)
    sigmoid = lambda u: 1.0 / (1.0 + math.exp(-max(-36.0, min(36.0, u))))
    logit = lambda p: math.log(p / (1 - p))

    def place(u: np.ndarray) -> tuple[float, ...]:
        total, share = sigmoid(u[2]), sigmoid(u[3])
        p = (u[0] * sd, var * math.exp(max(-60.0, min(20.0, u[1]))), total * share, total * (1 - share))
        return (*p, 2.05 + math.exp(max(-20.0, min(8.0, u[4])))) if distribution == "t" else p

    def loss_and_slope(u: np.ndarray) -> tuple[float, np.ndarray]:
        p = place(u)
        value, by = evaluate(p)
        if not math.isfinite(value):
            return math.inf, np.zeros(len(u))
        total, share = sigmoid(u[2]), sigmoid(u[3])
        g = [by[0] * sd, by[1] * p[1] * (abs(u[1] + 20) < 40), (by[2] * share + by[3] * (1 - share)) * total * (1 - total), (by[2] - by[3]) * total * share * (1 - share)]
        if distribution == "t":
            g.append(by[4] * (p[4] - 2.05) * (abs(u[4] + 6) < 14))
        return -value / n, -np.array(g) / n

    best = None
    for total, share in starts:
        u = [mean / sd, math.log(1 - total), logit(total), logit(share), *([math.log(6.0)] if distribution == "t" else [])]
        got = quasi_newton(loss_and_slope, np.array(u))
        best = got if best is None or got[1] < best[1] - 1e-10 else best
    u, value, converged = best
    return place(u), value * n, converged


def fit_garch_array(x: np.ndarray, distribution: str = "t") -> dict:
    """Constant mean GARCH(1,1) of largest likelihood."""
    var = max(float(np.var(x)), 1e-12)
    p, value, converged = search_garch(lambda p: likelihood_and_slope(x, p), len(x), float(np.mean(x)), var, distribution)
    mu, omega, alpha, beta, *nu = p
    s2 = variances(x - mu, omega, alpha, beta)
    k, n = len(p), len(x)
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "nu": nu[0] if nu else None, "log_likelihood": -value, "aic": 2 * value + 2 * k, "bic": 2 * value + k * math.log(n), "converged": converged, "sigma2": s2}


FIT = "distribution string, omega double, alpha double, beta double, mu double, nu double, log_likelihood double, aic double, bic double, n_observations long, realised_annualised double, last_variance double, arch_before double, arch_before_p double, arch_after double, arch_after_p double, converged boolean, reason string"


def _garch_row(x: np.ndarray, distribution: str, lags: int) -> tuple[dict, dict | None]:
    if len(x) < S.GARCH_MIN:
        return {"distribution": distribution, "n_observations": len(x), "reason": f"fewer than {S.GARCH_MIN} returns"}, None
    fit = fit_garch_array(x * SCALE, distribution)
    z = (x * SCALE - fit["mu"]) / np.sqrt(fit["sigma2"])
    before, after = arch_lm(x * SCALE - (x * SCALE).mean(), lags), arch_lm(z, lags)
    row = {k: v for k, v in fit.items() if k != "sigma2"} | {
        "distribution": distribution, "n_observations": len(x), "realised_annualised": float(np.std(x, ddof=1)) * math.sqrt(S.TRADING_DAYS), "last_variance": float(fit["sigma2"][-1]),
        "arch_before": before[0], "arch_before_p": before[1], "arch_after": after[0], "arch_after_p": after[1], "reason": None,
    }
    return row, {"sigma2": fit["sigma2"], "z": z}


def fit_garch(returns: DataFrame, distribution: str = "t", lags: int = S.ARCH_LAGS, by=BY, time: str = "d") -> DataFrame:
    """One row a series: parameters, criteria, ARCH tests before and after; NULLs and a reason for
    short ones. Derived columns: see derived()."""
    if distribution not in ("t", "normal"):
        raise ValueError(f"unknown distribution: {distribution!r}")
    names = [f.split()[0] for f in FIT.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row, _ = _garch_row(pdf.sort_values(time)["r"].to_numpy(dtype=float), distribution, lags)
        return pd.DataFrame([{**_keys(pdf, by), **{n: row.get(n) for n in names}}]).astype({"nu": "float64"})

    r = returns.where(present("r")).select(*by, time, "r")
    return derived(r.groupBy(*by).applyInPandas(one, f"{_schema(returns, by)}, {FIT}"))


def garch_series(returns: DataFrame, distribution: str = "t", by=BY, time: str = "d") -> DataFrame:
    """by, time, conditional_volatility (percent a day), annualised and standardised_residual."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        _, got = _garch_row(pdf["r"].to_numpy(dtype=float), distribution, S.ARCH_LAGS)
        if got is None:
            return pdf.iloc[:0].assign(conditional_volatility=0.0, annualised=0.0, standardised_residual=0.0).drop(columns="r")
        sigma = np.sqrt(got["sigma2"])
        return pdf.drop(columns="r").assign(conditional_volatility=sigma, annualised=sigma / SCALE * math.sqrt(S.TRADING_DAYS), standardised_residual=got["z"])

    r = returns.where(present("r")).select(*by, time, "r")
    return r.groupBy(*by).applyInPandas(one, f"{_schema(r, [*by, time])}, conditional_volatility double, annualised double, standardised_residual double")


def arch_tests(returns: DataFrame, lags: int = S.ARCH_LAGS, by=BY, time: str = "d") -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)["r"].to_numpy(dtype=float)
        stat, p = arch_lm(x - x.mean(), lags) if len(x) > lags + 1 else (None, None)
        return pd.DataFrame([{**_keys(pdf, by), "statistic": stat, "p_value": p, "lags": lags}]).astype({"statistic": "float64", "p_value": "float64"})

    r = returns.where(present("r")).select(*by, time, "r")
    return r.groupBy(*by).applyInPandas(one, f"{_schema(r, by)}, statistic double, p_value double, lags long").withColumn("has_arch_effects", F.col("p_value") < S.ALPHA)


def derived(fits: DataFrame) -> DataFrame:
    """Persistence, half-life, long-run level and whether it can be quoted, from parameters alone."""
    p = F.col("alpha") + F.col("beta")
    inside = (p > 0) & (p < 1)
    half = F.when(inside, F.ln(dbl(0.5)) / F.ln(F.when(inside, p))).when(p.isNotNull(), dbl(math.inf))
    level = F.when(p < 1, F.sqrt(F.col("omega") / F.nullif(1 - p, dbl(0))) / SCALE * dbl(math.sqrt(S.TRADING_DAYS)))
    out = fits.withColumns({"persistence": p, "is_stationary": p < 1, "half_life_days": half, "long_run_annualised": level, "long_run_is_reliable": p <= S.UNRELIABLE_PERSISTENCE})
    current = F.sqrt(F.col("last_variance")) / SCALE * dbl(math.sqrt(S.TRADING_DAYS))
    out = out.withColumn("current_annualised", current)
    if "arch_after_p" not in fits.columns:
        return out
    return out.withColumn("residuals_are_clean", F.col("arch_after_p") >= S.ALPHA).withColumn(
        "warnings",
        messages(
            (F.col("arch_before_p") >= S.ALPHA, "no ARCH effects before the fit"),
            (p >= 1, "the variance isn't stationary"),
            ((p > S.UNRELIABLE_PERSISTENCE) & (p < 1), "the long-run level is unreliable"),
            ((p > S.HIGH_PERSISTENCE) & (p < 1), "shocks decay slowly"),
            (F.col("arch_after_p") < S.ALPHA, "ARCH effects remain after the fit"),
        ),
    )


def forecast_path(fits: DataFrame, days: int = 10, by=BY) -> DataFrame:
    """Daily and annual volatility of each day ahead. Step h has the variance
    m + p^h (v - m), written as p^h v + omega (1 + p + ... + p^(h-1)), which also holds at p = 1."""
    if days < 1:
        raise ValueError("the horizon has to be a day or more")
    p = F.col("alpha") + F.col("beta")
    step = lambda v, _: F.col("omega") + p * v
    path = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda h: F.aggregate(F.sequence(F.lit(1), h), F.col("last_variance"), step))
    f = fits.where(F.col("omega").isNotNull()).withColumn("_path", path)
    out = f.select(*by, F.posexplode("_path").alias("_k", "_v"))
    daily = F.sqrt("_v") / SCALE
    return out.select(*by, (F.col("_k") + 1).alias("day"), daily.alias("daily_volatility"), (daily * dbl(math.sqrt(S.TRADING_DAYS))).alias("annualised_volatility"))


def cumulative_sigma(days: int) -> Column:
    """Volatility over the coming days: the root of the summed variances, not a scaled day."""
    p = F.col("alpha") + F.col("beta")
    start = F.struct(F.col("last_variance").alias("v"), dbl(0).alias("sum"))

    def step(s: Column, _: Column) -> Column:
        v = F.col("omega") + p * s["v"]
        return F.struct(v.alias("v"), (s["sum"] + v).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(days)), start, step, lambda s: F.sqrt(s["sum"]) / SCALE)


def conditional_var(fits: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, portfolio_value: float | None = None, by=BY) -> DataFrame:
    """VaR at today's conditional volatility. The fitted mean plays no part in it."""
    check(confidence, days)
    tail = 1.0 - confidence
    f = derived(fits).where(F.col("omega").isNotNull()).withColumn("conditional_sigma", cumulative_sigma(days))
    student = F.col("nu").isNotNull()
    z = F.when(student, t_quantile(dbl(tail), "nu") * F.sqrt((F.col("nu") - 2) / F.col("nu"))).otherwise(dbl(normal_quantile(tail)))
    var = loss(z * F.col("conditional_sigma"))
    regime = conditional_regime("current_annualised", "realised_annualised")
    return f.select(
        *by, dbl(confidence).alias("confidence"), F.lit(days).alias("horizon_days"), var.alias("var_return"), (var * dbl(portfolio_value) if portfolio_value is not None else F.lit(None).cast("double")).alias("var_value"),
        "conditional_sigma", "current_annualised", "realised_annualised", F.when(F.col("long_run_is_reliable"), F.col("long_run_annualised")).alias("long_run_annualised"), regime.alias("regime"),
    )


def normal_conditional_var(fits: DataFrame, confidence: float = S.CONFIDENCE, days: int = 1, by=BY) -> DataFrame:
    """The same for normal shocks; needs nothing but columns."""
    return fits.select(*by, loss(cumulative_sigma(days) * dbl(normal_quantile(1.0 - confidence))).alias("var_return"))


#: Refits of one series that share a task, and so one copy of its returns.
REFITS_A_TASK = 8


def rolling_conditional_var(returns: DataFrame, confidence: float = S.CONFIDENCE, refit_every: int = 50, min_window: int = 500, distribution: str = "t", by=BY, time: str = "d") -> DataFrame:
    """by, time, var for each day after the first min_window, from data before it alone.

    Runs of REFITS_A_TASK refits are rows and run in parallel, each with its series' returns up to
    its last cut. Between refits the days' shocks update the variance; a refit's state is the last
    in-sample variance and the day's shock isn't applied to it; every day's forecast is one
    expected step past the state.
    """
    check(confidence)
    if distribution not in ("t", "normal"):
        raise ValueError(f"unknown distribution: {distribution!r}")
    r = returns.where(present("r")).select(*by, time, "r")
    series = r.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(time, "r"))).alias("s")).where(F.size("s") > min_window)
    span = REFITS_A_TASK * refit_every
    parts = series.withColumn("first", F.explode(F.sequence(F.lit(min_window), F.size("s") - 1, F.lit(span))))
    last = F.least(F.col("first") + span, F.size("s"))
    days = F.transform(F.slice("s", F.col("first") + 1, last - F.col("first")), lambda x: x[time])
    parts = parts.select(*by, "first", days.alias("days"), F.transform(F.slice("s", F.lit(1), last), lambda x: x["r"]).alias("x"))
    normal = normal_quantile(1.0 - confidence)

    def ahead(x: np.ndarray, cut: int, stop: int) -> np.ndarray:
        """The estimates of days cut to stop - 1, by the fit on all before the cut."""
        f = fit_garch_array(x[:cut], distribution)
        z = normal if distribution == "normal" else specfun.t_ppf(1.0 - confidence, f["nu"]) * math.sqrt((f["nu"] - 2) / f["nu"])
        u = f["omega"] + f["alpha"] * (x[cut - 1 : stop - 1] - float(x[:cut].mean())) ** 2
        u[0] = f["sigma2"][-1]
        state = decayed_sums(u, f["beta"])
        return -np.expm1(z * np.sqrt(f["omega"] + (f["alpha"] + f["beta"]) * state) / SCALE)

    def run(batches):
        for pdf in batches:
            out = []
            for first, x in zip(pdf["first"], pdf["x"], strict=True):
                x = np.asarray(x, dtype=float) * SCALE
                out.append(np.concatenate([ahead(x, cut, min(cut + refit_every, len(x))) for cut in range(first, len(x), refit_every)]))
            yield pdf[[*by, "days"]].assign(var=out)

    kinds = f"{_schema(r, by)}, days array<{r.schema[time].dataType.simpleString()}>, var array<double>"
    context = r.sparkSession.sparkContext
    # Little data but long fits: a number of its own, which adaptive execution doesn't fold into one task.
    done = parts.repartition(max(context.defaultParallelism, int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by, "first").mapInPandas(run, kinds)
    return done.select(*by, F.explode(F.arrays_zip("days", "var")).alias("v")).select(*by, F.col("v.days").alias(time), "v.var")


def business_days(series: DataFrame, n: int, by=BY, time: str = "d") -> DataFrame:
    """by, day (from 1), d: the n weekdays after each series' last day, for the axis of a forecast."""
    last = series.groupBy(*by).agg(F.max(time).cast("date").alias("_last"))
    span = F.sequence(F.col("_last") + 1, F.col("_last") + (2 * n + 7))
    days = F.slice(F.filter(span, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, n)
    return last.select(*by, F.posexplode(days).alias("day", "d")).withColumn("day", F.col("day") + 1)
