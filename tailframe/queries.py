"""The driver's queries over the reference's own operators, each with its SQL where SQL has one.

Doubles are rounded on both sides: the engines add in different orders.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailframe.functions import distributions, specfun, sql, summaries
from tailframe.functions.columns import annual_return, cache_safe, chi2_tail_even, dbl, freshness, normal_density, normal_quantile, trend_label
from tailframe.operators import backtest, beta, blocks, composite, draws, drawdown, fit, gram, order, portfolio, recursion, returns, rollup, scorecard, simulate, tail, valuation, views, volatility
from tailframe.plans import panels
from tailframe.plans import settings as S
from tailframe.plans.storage import shared_dir
from tailframe.sources import envelope
from tailframe.sources import prices as sources
from tailframe.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# --- SQL fragments ---------------------------------------------------------------------------

P_LINE = "prices AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS p, count(*) AS volume FROM lineitem GROUP BY 1, 2)"
P_BENCH = "bench AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1)"
P_ORD = "prices AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2)"
R_LINE = f"{P_LINE}, rets AS (SELECT * FROM (SELECT series_id, d, ln(p / lag(p) OVER (PARTITION BY series_id ORDER BY d)) AS r FROM prices) WHERE r IS NOT NULL)"
R_ORD = R_LINE.replace(P_LINE, P_ORD)
R_SUPP = R_LINE.replace("l_returnflag", "CAST(l_suppkey AS VARCHAR)")
S_LINE = f"{P_LINE}, rets AS (SELECT * FROM (SELECT series_id, d, p / lag(p) OVER (PARTITION BY series_id ORDER BY d) - 1 AS r FROM prices) WHERE r IS NOT NULL)"
ALIGNED = f"{R_LINE}, {P_BENCH}, br AS (SELECT * FROM (SELECT d, ln(p / lag(p) OVER (ORDER BY d)) AS b FROM bench) WHERE b IS NOT NULL), al AS (SELECT rets.*, b FROM rets JOIN br USING (d))"
VOL = "vol AS (SELECT series_id, d, CASE WHEN count(r) OVER w = 60 THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"
DD = "dd AS (SELECT *, (p - peak) / peak AS dd, row_number() OVER (PARTITION BY series_id ORDER BY d) AS rn FROM (SELECT series_id, d, p, max(p) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM prices))"
Q95, Q99 = 1.0 - 0.95, 1.0 - 0.99
MOM = "m AS (SELECT series_id, avg(r) AS mean, stddev_samp(r) AS std, count(*) AS n FROM rets GROUP BY 1), c AS (SELECT m.*, m2, m3, m4 FROM m JOIN (SELECT rets.series_id, avg((r - mean) ** 2) AS m2, avg((r - mean) ** 3) AS m3, avg((r - mean) ** 4) AS m4 FROM rets JOIN m USING (series_id) GROUP BY 1) USING (series_id)), s AS (SELECT *, m3 / m2 ** 1.5 AS skew, m4 / (m2 * m2) - 3 AS kurt FROM c)"
TAIL = f"k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY r) AS rk, count(*) OVER (PARTITION BY series_id) AS n FROM rets), tail AS (SELECT series_id, avg(r) AS mean, count(*) AS k, max(n) AS n FROM k WHERE rk <= greatest(1, ceil(round(n * {Q95!r}::DOUBLE, 9))) GROUP BY 1)"
ROLL = "v AS (SELECT series_id, d, r, CASE WHEN count(r) OVER w = {w} THEN -(exp(quantile_cont(r, {q!r}) OVER w) - 1) END AS var FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {b} PRECEDING AND CURRENT ROW))"
HITS = f"{R_LINE}, {ROLL.format(w=252, b=251, q=Q95)}, hit AS (SELECT series_id, d, var, -(exp(r) - 1) AS realised_loss, CASE WHEN -(exp(r) - 1) > var THEN 1 ELSE 0 END AS b FROM v WHERE var IS NOT NULL)"
TRANS = "t AS (SELECT series_id, count(*) AS n, sum(b) AS x, count(*) FILTER (pb = 0 AND b = 0) AS n00, count(*) FILTER (pb = 0 AND b = 1) AS n01, count(*) FILTER (pb = 1 AND b = 0) AS n10, count(*) FILTER (pb = 1 AND b = 1) AS n11 FROM (SELECT *, lag(b) OVER (PARTITION BY series_id ORDER BY d) AS pb FROM hit) GROUP BY 1)"
KUPIEC = f"CASE WHEN x = 0 THEN -2 * n * {math.log(1 - Q95)!r} WHEN x = n THEN -2 * n * {math.log(Q95)!r} ELSE -2 * (x * {math.log(Q95)!r} + (n - x) * {math.log(1 - Q95)!r} - x * ln(x::DOUBLE / n) - (n - x) * ln(1 - x::DOUBLE / n)) END"
XL = lambda n, p: f"CASE WHEN {p} > 0 THEN ({n}) * ln({p}) ELSE 0 END"
CHRIS = (
    "CASE WHEN n01 + n11 = 0 OR n00 + n01 = 0 OR n10 + n11 = 0 OR n00 + n10 = 0 THEN 0 ELSE greatest(0, -2 * ("
    + f"{XL('n00 + n10', '(1 - (n01 + n11)::DOUBLE / (n00 + n01 + n10 + n11))')} + {XL('n01 + n11', '((n01 + n11)::DOUBLE / (n00 + n01 + n10 + n11))')}"
    + f" - {XL('n00', '(1 - n01::DOUBLE / (n00 + n01))')} - {XL('n01', '(n01::DOUBLE / (n00 + n01))')} - {XL('n10', '(1 - n11::DOUBLE / (n10 + n11))')} - {XL('n11', '(n11::DOUBLE / (n10 + n11))')})) END"
)
RUNS = "runs AS (SELECT series_id, max(run) AS mr FROM (SELECT series_id, i, sum(b) AS run FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) - sum(b) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS i FROM hit) GROUP BY 1, 2) GROUP BY 1)"
NOW = "2001-01-01 00:00:00"
RAW = "raw AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_totalprice END AS close, o_orderkey AS ingest_seq FROM orders)"
KEPT = f"{RAW}, kept AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY series_id, d ORDER BY ingest_seq DESC) = 1), past AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY series_id ORDER BY d), d) AS gap FROM kept WHERE d <= TIMESTAMP '{NOW}'), good AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY d) - 1 AS move FROM past WHERE close > 0)"
WTS = "wts AS (SELECT * FROM (VALUES ('P1', 'A', 0.5), ('P1', 'N', 0.3), ('P1', 'R', 0.2), ('P2', 'A', 2.0), ('P2', 'R', -1.0)) t(portfolio_id, series_id, w0))"
PANEL = f"{R_LINE}, {WTS}, nw AS (SELECT portfolio_id, series_id, w0::DOUBLE / sum(w0::DOUBLE) OVER (PARTITION BY portfolio_id) AS w, count(*) OVER (PARTITION BY portfolio_id) AS m FROM wts), j AS (SELECT portfolio_id, series_id, d, exp(r) - 1 AS s, w, m, count(*) OVER (PARTITION BY portfolio_id, d) AS c FROM rets JOIN nw USING (series_id)), pn AS (SELECT portfolio_id, series_id, d, s, w FROM j WHERE c = m)"
COV = "cv AS (SELECT a.portfolio_id, a.series_id AS i, b.series_id AS j, any_value(a.w) AS wi, any_value(b.w) AS wj, covar_samp(a.s, b.s) * 252 AS cov, covar_samp(a.s, b.s) / (stddev_samp(a.s) * stddev_samp(b.s)) AS corr FROM pn a JOIN pn b USING (portfolio_id, d) GROUP BY 1, 2, 3)"
CONTRIB = "cb0 AS (SELECT portfolio_id, i AS series_id, sum(wj * cov) AS m, any_value(wi) AS w, max(CASE WHEN i = j THEN sqrt(cov) END) AS own FROM cv GROUP BY 1, 2), cb AS (SELECT *, sqrt(sum(w * m) OVER (PARTITION BY portfolio_id)) AS vol FROM cb0)"
DAILY = "dy AS (SELECT portfolio_id, d, sum(w * s) AS r FROM pn GROUP BY 1, 2)"
RATIOS = "st AS (SELECT CAST(c_nationkey AS VARCHAR) AS entity, year(o_orderdate) AS fiscal_year, avg(o_totalprice) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), ra AS (SELECT entity, fiscal_year, CASE WHEN n % 5 <> 0 THEN m / lo / 10 END AS interest_coverage, hi / m AS debt_to_equity, m / 100000 AS current_ratio, CASE WHEN n % 7 <> 0 THEN f::DOUBLE / n * 2 END AS cfo_to_net_income, f::DOUBLE / n / 4 - 0.1::DOUBLE AS fcf_margin, m / hi AS ebitda_margin FROM st), rc AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fiscal_year DESC) <= 4)"
SLOPE = "lg AS (SELECT entity, fiscal_year, metric, v FROM (UNPIVOT rc ON interest_coverage, debt_to_equity, current_ratio, cfo_to_net_income, fcf_margin, ebitda_margin INTO NAME metric VALUE v)), sl AS (SELECT entity, metric, count(*) AS n_years, avg(v) AS mean, CASE WHEN count(*) >= 3 THEN covar_pop(x, v) / nullif(var_pop(x), 0) END AS slope FROM (SELECT *, (row_number() OVER (PARTITION BY entity, metric ORDER BY fiscal_year) - 1)::DOUBLE AS x FROM lg) GROUP BY 1, 2)"


def sc(v: str, a: float, b: float) -> str:
    return f"CASE WHEN ({v}) IS NOT NULL THEN greatest(0, least(1, (({v}) - {a!r}::DOUBLE) / {b - a!r}::DOUBLE)) * 100 END"


def mean_of(*parts: str) -> str:
    top = " + ".join(f"coalesce({p}, 0)" for p in parts)
    n = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in parts)
    return f"({top}) / nullif({n}, 0)"


def weighted_of(parts: list[tuple[str, float]]) -> str:
    top = " + ".join(f"coalesce({p}, 0) * {w!r}::DOUBLE" for p, w in parts)
    n = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w!r}::DOUBLE END" for p, w in parts)
    return f"({top}) / nullif({n}, 0)"


_sl = lambda m: f"max(CASE WHEN metric = '{m}' THEN slope END) AS s_{m}"
FUND = (
    f"{RATIOS}, {SLOPE}, pv AS (SELECT entity, {', '.join(map(_sl, scorecard.TRENDS))}, max(CASE WHEN metric = 'cfo_to_net_income' AND n_years >= 3 THEN mean END) AS sus FROM sl GROUP BY 1), "
    "la AS (SELECT * FROM rc QUALIFY row_number() OVER (PARTITION BY entity ORDER BY fiscal_year DESC) = 1), "
    f"sr AS (SELECT la.*, pv.* EXCLUDE (entity), {sc('debt_to_equity', 0.3, 3.0)} AS l1, {sc('interest_coverage', 15.0, 2.0)} AS l2, {sc('current_ratio', 2.5, 0.8)} AS li, {sc('sus', 1.3, 0.6)} AS e1, {sc('fcf_margin', 0.20, -0.05)} AS e2, "
    + ", ".join(f"{sc(f's_{c}', a, b)} AS d{k}" for k, (c, a, b) in enumerate(scorecard.SLOPES))
    + f" FROM la LEFT JOIN pv USING (entity)), pl AS (SELECT *, {mean_of('l1', 'l2')} AS leverage_risk, li AS liquidity_risk, {mean_of('e1', 'e2')} AS earnings_quality_risk, {mean_of('d0', 'd1', 'd2', 'd3', 'd4')} AS deterioration_risk FROM sr), fu AS (SELECT *, {mean_of('leverage_risk', 'liquidity_risk', 'earnings_quality_risk', 'deterioration_risk')} AS overall_risk FROM pl)"
)
RATING = lambda c: f"CASE WHEN {c} >= 70 THEN 'High' WHEN {c} >= 50 THEN 'Elevated' WHEN {c} >= 30 THEN 'Moderate' ELSE 'Low' END"
SUP = "su AS (SELECT CAST(s_suppkey AS VARCHAR) AS entity, 100.0::DOUBLE + s_suppkey % 17 AS b, s_acctbal / 20 AS debt, (20.0::DOUBLE + s_suppkey % 30) AS price, 0.08::DOUBLE + (s_suppkey % 5) * 0.005::DOUBLE AS wacc, 0.02::DOUBLE + (s_suppkey % 3) * 0.005::DOUBLE AS g FROM supplier)"


def pv_sql(w: str) -> str:
    return "(" + " + ".join(f"b * {1.0 + i * 0.03!r}::DOUBLE / pow(1 + ({w}), {i})" for i in range(1, 6)) + ")"


def tv_sql(w: str, g: str) -> str:
    return f"(b * {1.0 + 5 * 0.03!r}::DOUBLE * (1 + ({g})) / nullif(({w}) - ({g}), 0) / pow(1 + ({w}), 5))"


def dcf_sql(w: str, g: str) -> str:
    return f"CASE WHEN ({g}) < ({w}) - 0.005::DOUBLE THEN ({pv_sql(w)} + {tv_sql(w, g)} - debt) / 50 END"


D = lambda x: f"{x!r}::DOUBLE"
SENS = f"vs AS (SELECT *, {dcf_sql('wacc', 'g')} AS implied, {tv_sql('wacc', 'g')} / ({pv_sql('wacc')} + {tv_sql('wacc', 'g')}) AS tshare, {dcf_sql(f'wacc - {D(S.WACC_SHOCK)}', 'g')} AS wd, {dcf_sql(f'wacc + {D(S.WACC_SHOCK)}', 'g')} AS wu, {dcf_sql('wacc', f'g - {D(S.GROWTH_SHOCK)}')} AS gd, {dcf_sql('wacc', f'g + {D(S.GROWTH_SHOCK)}')} AS gu FROM su), vz AS (SELECT *, CASE WHEN implied > 0 THEN (wd - wu) / (2 * implied) END AS wsens, CASE WHEN implied > 0 THEN (gu - gd) / (2 * implied) END AS gsens FROM vs)"
IMPLIED = "wacc - 0.001::DOUBLE * (CAST(entity AS INT) % 60)"
VSCORE = f"vw AS (SELECT *, {sc('tshare', 0.40, 0.85)} AS v1, {sc('abs(wsens)', 0.02, 0.08)} AS v2, {sc(f'abs(wacc - ({IMPLIED}))', 0.01, 0.05)} AS v3 FROM vz), vx AS (SELECT *, {weighted_of([('v1', 0.40), ('v2', 0.35), ('v3', 0.25)])} AS vscore FROM vw)"
MARKET = (
    f"{ALIGNED}, {VOL}, {DD}, hv AS (SELECT series_id, stddev_samp(r) * sqrt(252) AS volatility, -(exp(quantile_cont(r, {Q99!r})) - 1) AS var_99 FROM rets GROUP BY 1), "
    "mx AS (SELECT series_id, min(dd) AS max_drawdown FROM dd GROUP BY 1), "
    "bt AS (SELECT series_id, covar_samp(r, b) / var_samp(b) AS beta, count(*) AS n, corr(r, b) ** 2 AS r2 FROM al GROUP BY 1), "
    "bc AS (SELECT *, CASE WHEN n < 30 THEN 'low' WHEN r2 >= 0.30 THEN 'high' WHEN r2 >= 0.10 THEN 'medium' ELSE 'low' END AS conf FROM bt), "
    "rg AS (SELECT series_id, CASE WHEN q >= 1.75 THEN 'elevated' WHEN q <= 0.6 THEN 'subdued' WHEN q IS NULL THEN 'unknown' ELSE 'normal' END AS regime FROM (SELECT series_id, arg_max(vol, d) / nullif(avg(vol), 0) AS q FROM vol WHERE vol IS NOT NULL GROUP BY 1)), "
    "mm AS (SELECT hv.series_id, volatility, var_99, max_drawdown, beta, conf, coalesce(regime, 'normal') AS regime FROM hv LEFT JOIN mx USING (series_id) LEFT JOIN bc USING (series_id) LEFT JOIN rg USING (series_id)), "
    f"ms AS (SELECT *, {sc('volatility', 0.15, 0.55)} AS x1, {sc('var_99', 0.02, 0.08)} AS x2, {sc('abs(max_drawdown)', 0.15, 0.60)} AS x3, CASE WHEN conf <> 'low' THEN {sc('beta', 0.8, 2.5)} END AS x4 FROM mm), "
    f"mk AS (SELECT *, greatest(0, least(100, {weighted_of([('x1', 0.30), ('x2', 0.30), ('x3', 0.25), ('x4', 0.15)])} + CASE regime WHEN 'elevated' THEN 8.0 WHEN 'subdued' THEN -8.0 ELSE 0.0 END)) AS mscore FROM ms)"
)


# Probabilities by Simpson's rule: NODES is joined, and the sum is over its rows.
NODES = "(SELECT k, CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(4001) r(k))"


def t_tail_sql(t: str, v: str) -> str:
    """Two-sided p-value: 1 less the integral of the density from -|t| to |t|."""
    density = f"exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5 * ln({v} * pi()) - ({v} + 1) / 2 * ln(1 + pow(abs({t}) * k / 4000, 2) / {v}))"
    return f"greatest(0, 1 - 2 * abs({t}) / 4000 / 3 * sum(c * {density}))"


def chi2_tail_sql(x: str) -> str:
    """With one degree of freedom: 1 less the integral of the normal density from -sqrt(x) to sqrt(x)."""
    return f"greatest(0, 1 - 2 * sqrt({x}) / 4000 / 3 * sum(c * exp(-{x} * pow(k / 4000.0::DOUBLE, 2) / 2) / sqrt(2 * pi())))"


# --- Returns ---------------------------------------------------------------------------------


def line_returns(spark, folder):
    return returns.log_returns(panels.line_prices(spark, folder))


@query(f"WITH {R_LINE} SELECT series_id, d, round(r, 8) AS r FROM rets")
def log_returns(spark, folder):
    return rounded(line_returns(spark, folder))


@query(f"WITH {S_LINE} SELECT series_id, d, round(r, 8) AS r FROM rets")
def simple_returns(spark, folder):
    return rounded(returns.simple_returns(panels.line_prices(spark, folder)))


@query(f"WITH {R_LINE} SELECT series_id, d, round(100 * exp(sum(r) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING)), 6) AS level FROM rets")
def price_index(spark, folder):
    return rounded(returns.price_index(line_returns(spark, folder)).select("series_id", "d", "level"), 6)


@query(f"WITH {R_LINE} SELECT series_id, round(sum(r), 8) AS cumulative_return, round(avg(r), 8) AS mean_return, count(*) AS n FROM rets GROUP BY 1")
def cumulative_return(spark, folder):
    return rounded(returns.cumulative_return(line_returns(spark, folder)))


@query(f"WITH {R_LINE} SELECT series_id, round(avg(r) * 252, 8) AS linear, round(pow(1 + avg(r), 252) - 1, 8) AS geometric FROM rets GROUP BY 1")
def annualised_return(spark, folder):
    m = returns.cumulative_return(line_returns(spark, folder))
    return rounded(m.select("series_id", annual_return("mean_return").alias("linear"), annual_return("mean_return", method="simple").alias("geometric")))


@query(f"WITH {R_LINE} SELECT series_id, d, round(-(exp(r) - 1), 8) AS realised_loss FROM rets")
def realised_loss(spark, folder):
    return rounded(portfolio.loss_series(line_returns(spark, folder)).select("series_id", "d", "realised_loss"))


@query(
    f"WITH {R_LINE}, s AS (SELECT series_id, exp(r) - 1 AS s FROM rets), m AS (SELECT series_id, min(s) AS lo, max(s) AS hi FROM s GROUP BY 1) SELECT series_id, CAST(least(floor((s - lo) / ((hi - lo) / 120)), 119) AS INT) AS bin, count(*) AS n FROM s JOIN m USING (series_id) GROUP BY 1, 2"
)
def return_histogram(spark, folder):
    return tail.return_histogram(line_returns(spark, folder))


# --- Volatility ------------------------------------------------------------------------------


@query(
    f"WITH {R_LINE}, l AS (SELECT * FROM rets QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d DESC) <= 252), s AS (SELECT series_id, stddev_samp(r) AS v, count(*) AS n FROM l GROUP BY 1) SELECT series_id, round(v, 8) AS daily, round(v * sqrt(5), 8) AS weekly, round(v * sqrt(21), 8) AS monthly, round(v * sqrt(252), 8) AS annualised, 252::BIGINT AS \"window\", n AS n_observations FROM s"
)
def hist_volatility(spark, folder):
    return rounded(volatility.historical_volatility(line_returns(spark, folder), 252))


def rolling(spark, folder):
    return volatility.rolling_volatility(line_returns(spark, folder), 60)


@query(f"WITH {R_LINE}, {VOL} SELECT series_id, d, round(vol, 7) AS vol FROM vol")
def rolling_volatility_60(spark, folder):
    return rounded(rolling(spark, folder).select("series_id", "d", "vol"), 7)


@query(
    f"WITH {R_LINE}, {VOL}, g AS (SELECT series_id, arg_max(vol, d) AS c, avg(vol) AS a FROM vol WHERE vol IS NOT NULL GROUP BY 1) SELECT series_id, round(c, 7) AS current_vol, round(a, 7) AS average_vol, CASE WHEN c / a >= 1.75 THEN 'elevated' WHEN c / a <= 0.6 THEN 'subdued' ELSE 'normal' END AS regime FROM g"
)
def volatility_regime(spark, folder):
    return rounded(volatility.regimes(rolling(spark, folder)), 7)


@query(
    f"WITH {R_LINE}, {VOL}, l AS (SELECT series_id, d, vol, median(vol) OVER (PARTITION BY series_id) * 1.2 AS lim FROM vol WHERE vol IS NOT NULL), f AS (SELECT *, CASE WHEN vol > lim THEN 1 ELSE 0 END AS s FROM l), i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) - sum(s) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT series_id, min(d) AS start_date, max(d) AS end_date, round(max(vol), 7) AS peak_volatility, count(*) AS duration_days FROM i WHERE s = 1 GROUP BY series_id, k"
)
def volatility_spikes(spark, folder):
    """At 1.2 times the median: at 1.75 these panels have hardly any episode."""
    return rounded(volatility.spike_episodes(rolling(spark, folder), 1.2), 7)


@query(f"WITH {R_LINE}, {VOL} SELECT series_id, round(median(vol) * 1.75, 7) AS threshold FROM vol WHERE vol IS NOT NULL GROUP BY 1")
def spike_threshold(spark, folder):
    return rounded(volatility.spike_threshold(rolling(spark, folder)), 7)


# --- Beta ------------------------------------------------------------------------------------


def aligned_with_benchmark(spark, folder):
    return beta.align(line_returns(spark, folder), returns.log_returns(panels.benchmark_prices(spark, folder)))


REG = f"WITH {ALIGNED}, q AS (SELECT series_id, count(*) AS n, covar_samp(r, b) / var_samp(b) AS beta, regr_slope(r, b) AS sl, regr_intercept(r, b) AS a, corr(r, b) AS cr, regr_r2(r, b) AS r2, var_samp(r) AS vr, var_samp(b) AS vb FROM al GROUP BY 1)"


@query(f"{REG} SELECT series_id, round(beta, 6) AS beta_moments, round(sl, 6) AS beta_regression, round(a, 7) AS alpha, round(r2, 6) AS r_squared, round(cr, 6) AS correlation, round(sqrt((vr - sl * sl * vb) / vb / (n - 2)), 7) AS standard_error, round(sl / sqrt((vr - sl * sl * vb) / vb / (n - 2)), 4) AS t_statistic, n AS n_observations, abs(beta - sl) <= 1e-8 * greatest(abs(beta), 1) AS routes_agree FROM q")
def beta_ols(spark, folder):
    r = beta.regression(aligned_with_benchmark(spark, folder), p_values=False)
    digits = {"alpha": 7, "standard_error": 7, "t_statistic": 4}
    whole = ("series_id", "n_observations", "routes_agree")
    return r.select(*whole, *(F.round(c, digits.get(c, 6)).alias(c) for c in r.columns if c not in (*whole, "confidence")))


@query(f"{REG} SELECT series_id, CASE WHEN n < 30 THEN 'low' WHEN r2 >= 0.30 THEN 'high' WHEN r2 >= 0.10 THEN 'medium' ELSE 'low' END AS confidence FROM q")
def beta_confidence(spark, folder):
    return beta.regression(aligned_with_benchmark(spark, folder), p_values=False).select("series_id", "confidence")


@query(
    f"{REG}, t AS (SELECT series_id, sl / sqrt((vr - sl * sl * vb) / vb / (n - 2)) AS t, (n - 2)::DOUBLE AS v FROM q), p AS (SELECT series_id, {t_tail_sql('t', 'v')} AS p_value FROM t, {NODES} GROUP BY series_id, t, v) SELECT series_id, round(t, 4) AS t_statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS is_significant FROM t JOIN p USING (series_id)"
)
def beta_p_value(spark, folder):
    """In SQL by Simpson's rule over the density, in Spark by the incomplete beta function."""
    b = beta.regression(aligned_with_benchmark(spark, folder))
    return b.select("series_id", F.round("t_statistic", 4).alias("t_statistic"), F.round("p_value", 6).alias("p_value"), "is_significant")


@query(
    f"WITH {ALIGNED} SELECT series_id, d, round(CASE WHEN count(*) OVER w = 60 THEN covar_samp(r, b) OVER w / nullif(var_samp(b) OVER w, 0) END, 5) AS rolling_beta FROM al WINDOW w AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
)
def rolling_beta_60(spark, folder):
    return rounded(beta.rolling_beta(aligned_with_benchmark(spark, folder)).select("series_id", "d", "rolling_beta"), 5)


@query(
    f"{REG}, sp AS (SELECT series_id, min(b) AS lo, max(b) AS hi FROM al GROUP BY 1) SELECT series_id, CAST(k AS INT) AS k, round(lo + (hi - lo) * k / 49.0::DOUBLE, 7) AS x, round(a + sl * (lo + (hi - lo) * k / 49.0::DOUBLE), 6) AS y FROM q JOIN sp USING (series_id), range(50) t(k)"
)
def fitted_line(spark, folder):
    f = beta.fitted_line(aligned_with_benchmark(spark, folder))
    return f.select("series_id", "k", F.round("x", 7).alias("x"), F.round("y", 6).alias("y"))


# --- Drawdown --------------------------------------------------------------------------------


@query(f"WITH {P_LINE}, {DD} SELECT series_id, d, round(dd, 8) AS dd FROM dd")
def drawdown_series(spark, folder):
    return rounded(drawdown.drawdowns(panels.line_prices(spark, folder)).select("series_id", "d", "dd"))


@query(
    f"WITH {P_LINE}, {DD}, w AS (SELECT series_id, min(d) AS wd FROM dd JOIN (SELECT series_id, min(dd) AS m FROM dd GROUP BY 1) USING (series_id) WHERE dd.dd = m GROUP BY 1) SELECT series_id, round(arg_max(dd, d), 8) AS current_drawdown, round(min(dd), 8) AS max_drawdown, any_value(wd) AS max_drawdown_date, max(rn) - max(CASE WHEN p >= peak THEN rn END) AS current_duration_days, arg_max(dd, d) < -1e-9 AS is_in_drawdown FROM dd JOIN w USING (series_id) GROUP BY 1"
)
def drawdown_summary(spark, folder):
    return rounded(drawdown.drawdown_summary(panels.line_prices(spark, folder)))


@query(
    f"WITH {P_LINE}, {DD}, t AS (SELECT *, CASE WHEN p >= peak - 1e-12 THEN 1 ELSE 0 END AS top FROM dd), g AS (SELECT *, sum(top) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM t), "
    "h AS (SELECT series_id, k, d AS pd, p AS pp, rn AS prn, lead(d) OVER (PARTITION BY series_id ORDER BY k) AS nd, lead(rn) OVER (PARTITION BY series_id ORDER BY k) AS nrn FROM g WHERE top = 1), "
    "l AS (SELECT series_id, k, d AS td, p AS tp, rn AS trn FROM g WHERE top = 0 QUALIFY row_number() OVER (PARTITION BY series_id, k ORDER BY p, rn) = 1) "
    "SELECT series_id, pd AS peak_date, td AS trough_date, round((tp - pp) / pp, 8) AS depth, trn - prn AS days_to_trough, nd AS recovery_date, nrn - trn AS days_to_recovery FROM h JOIN l USING (series_id, k) WHERE (tp - pp) / pp <= -0.1"
)
def drawdown_episodes(spark, folder):
    return rounded(drawdown.drawdown_episodes(panels.line_prices(spark, folder)))


# --- Tails -----------------------------------------------------------------------------------


@query(f"WITH {R_ORD} SELECT series_id, count(*) AS n_observations, round(-(exp(quantile_cont(r, {Q95!r})) - 1), 8) AS var_95, round(-(exp(quantile_cont(r, {Q99!r})) - 1), 8) AS var_99, round(stddev_samp(r), 8) AS daily FROM rets GROUP BY 1")
def hist_var_by_series(spark, folder):
    r = returns.log_returns(panels.order_prices(spark, folder))
    a = tail.historical_var(r, 0.95).select("series_id", "n_observations", F.col("var_return").alias("var_95"))
    b = tail.historical_var(r, 0.99).select("series_id", F.col("var_return").alias("var_99"))
    return rounded(a.join(b, "series_id").join(volatility.historical_volatility(r).select("series_id", "daily"), "series_id"))


@query(
    f"WITH {R_LINE}, q AS (SELECT series_id, quantile_cont(r, {Q95!r}) AS q, min(r) AS lo, count(*) AS n FROM rets GROUP BY 1) SELECT series_id, round(-(exp(q * sqrt(10)) - 1), 8) AS var_return, round(1000000 * -(exp(q * sqrt(10)) - 1), 2) AS var_value, n AS n_observations, (SELECT count(*) FROM rets r2 WHERE r2.series_id = q.series_id AND r <= q) AS tail_observations, round(-(exp(lo * sqrt(10)) - 1), 8) AS worst_observed_loss FROM q"
)
def hist_var_horizon10(spark, folder):
    v = tail.historical_var(line_returns(spark, folder), 0.95, 10, 1e6)
    return v.select("series_id", F.round("var_return", 8).alias("var_return"), F.round("var_value", 2).alias("var_value"), "n_observations", "tail_observations", F.round("worst_observed_loss", 8).alias("worst_observed_loss"))


@query(f"WITH {R_LINE}, {TAIL} SELECT series_id, round(-(exp(mean) - 1), 8) AS es_return, k AS tail_observations FROM tail")
def hist_es(spark, folder):
    return rounded(tail.historical_es(line_returns(spark, folder)).select("series_id", "es_return", "tail_observations"))


@query(f"WITH {R_LINE}, {TAIL}, q AS (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS v FROM rets GROUP BY 1) SELECT series_id, round(v, 8) AS var_return, round(-(exp(mean) - 1) / v, 6) AS tail_severity FROM tail JOIN q USING (series_id)")
def tail_severity(spark, folder):
    t = tail.historical_es(line_returns(spark, folder))
    return t.select("series_id", F.round("var_return", 8).alias("var_return"), F.round("tail_severity", 6).alias("tail_severity"))


@query(f"WITH {R_LINE}, {MOM} SELECT series_id, round(mean, 8) AS mean, round(std, 8) AS std, round(skew, 6) AS skewness, round(kurt, 6) AS excess_kurtosis, round(n / 6.0::DOUBLE * (skew * skew + kurt * kurt / 4), 4) AS jarque_bera, round(exp(-n / 12.0::DOUBLE * (skew * skew + kurt * kurt / 4)), 6) AS jarque_bera_p, n AS n_observations, kurt > 1.0 AS has_fat_tails FROM s")
def dist_shape_jb(spark, folder):
    f = tail.fit_distribution(line_returns(spark, folder))
    digits = {"mean": 8, "std": 8, "jarque_bera": 4}
    return f.select("series_id", *(F.round(c, digits.get(c, 6)).alias(c) for c in ("mean", "std", "skewness", "excess_kurtosis", "jarque_bera", "jarque_bera_p")), "n_observations", "has_fat_tails")


Z95 = normal_quantile(Q95)
PHI = normal_density(Z95) / Q95


@query(f"WITH {R_LINE}, {MOM} SELECT series_id, round(-(exp(mean * 10 + {Z95!r}::DOUBLE * std * sqrt(10)) - 1), 8) AS var_return FROM m")
def parametric_normal_var(spark, folder):
    return rounded(tail.parametric_var(line_returns(spark, folder), 0.95, 10).select("series_id", "var_return"))


@query(f"WITH {R_LINE}, {MOM} SELECT series_id, round(-(exp(mean - std * {PHI!r}::DOUBLE) - 1), 8) AS es_return FROM m")
def normal_es(spark, folder):
    return rounded(tail.parametric_var(line_returns(spark, folder)).select("series_id", "es_return"))


@query(
    f"WITH {R_LINE}, {MOM}, z AS (SELECT m.series_id, -(exp(mean + {Z95!r}::DOUBLE * std) - 1) AS nv, hv FROM m JOIN (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS hv FROM rets GROUP BY 1) USING (series_id)) SELECT series_id, round(nv, 8) AS normal_var, round(hv, 8) AS historical_var, round(hv - nv, 8) AS gap, round(hv / nv, 6) AS ratio, CASE WHEN hv - nv > 0 THEN 'the normal tail is too thin' ELSE 'the sample shows no worse tail' END AS reading FROM z"
)
def normal_vs_hist_gap(spark, folder):
    g = tail.normal_vs_historical(line_returns(spark, folder))
    return g.select("series_id", *(F.round(c, 8).alias(c) for c in ("normal_var", "historical_var", "gap")), F.round("ratio", 6).alias("ratio"), "reading")


@query(f"WITH {R_LINE}, {MOM}, {TAIL} SELECT series_id, round(-(exp(tail.mean) - 1), 8) AS es_historical, round(-(exp(m.mean - std * {PHI!r}::DOUBLE) - 1), 8) AS es_normal, round((-(exp(tail.mean) - 1) + (exp(m.mean - std * {PHI!r}::DOUBLE) - 1)) / -(exp(tail.mean) - 1), 6) AS shortfall FROM tail JOIN m USING (series_id)")
def es_shortfall(spark, folder):
    r = line_returns(spark, folder)
    e = portfolio.es_shortfall(tail.historical_es(r), tail.parametric_var(r))
    return e.select("series_id", F.round("es_historical", 8).alias("es_historical"), F.round("es_normal", 8).alias("es_normal"), F.round("shortfall", 6).alias("shortfall"))


SUPPLIER_TAIL = f"WITH {R_SUPP}, {TAIL}, q AS (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS v, stddev_samp(r) * sqrt(252) AS vol FROM rets GROUP BY 1)"


@query(f"{SUPPLIER_TAIL} SELECT series_id, tail.n AS n_observations, round(vol, 8) AS volatility, round(v, 8) AS var_return, round(-(exp(mean) - 1), 8) AS es_return FROM tail JOIN q USING (series_id)")
def supplier_tail(spark, folder):
    """A panel of many series: one a supplier."""
    r = returns.log_returns(panels.supplier_prices(spark, folder))
    e = tail.historical_es(r).select("series_id", "var_return", "es_return")
    return rounded(e.join(volatility.historical_volatility(r).select("series_id", "n_observations", F.col("annualised").alias("volatility")), "series_id"))


SUPPLIER_DD = f"WITH {P_LINE}, {DD}".replace("l_returnflag", "CAST(l_suppkey AS VARCHAR)")


@query(f"{SUPPLIER_DD} SELECT series_id, round(min(dd), 8) AS max_drawdown, round(arg_max(dd, d), 8) AS current_drawdown FROM dd GROUP BY 1")
def supplier_drawdown(spark, folder):
    return rounded(drawdown.drawdown_summary(panels.supplier_prices(spark, folder)).select("series_id", "max_drawdown", "current_drawdown"))


SUPPLIER_ROLL = f"WITH {R_SUPP}, {ROLL.format(w=100, b=99, q=Q95)}"


@query(f"{SUPPLIER_ROLL} SELECT series_id, count(*) AS n_days, count(*) FILTER (-(exp(r) - 1) > var) AS n_breaches FROM v WHERE var IS NOT NULL GROUP BY 1")
def supplier_breaches(spark, folder):
    """A rolling VaR of 100 days for each supplier, against what came."""
    r = returns.log_returns(panels.supplier_prices(spark, folder))
    return tail.breach_rate(tail.mark_breaches(tail.rolling_historical_var(r, 100))).select("series_id", "n_days", "n_breaches")


@query(f"WITH {R_LINE}, {TAIL}, q AS (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS v FROM rets GROUP BY 1) SELECT series_id, round(v, 8) AS var_return, round(-(exp(mean) - 1), 8) AS es_return, k AS tail_observations FROM tail JOIN q USING (series_id)")
def long_series_tail(spark, folder):
    """The same by nested histograms, which gather no series."""
    return rounded(order.long_tail(line_returns(spark, folder)).select("series_id", "var_return", "es_return", "tail_observations"))


# --- Backtests -------------------------------------------------------------------------------


def rolled_var(spark, folder, window=252):
    return tail.rolling_historical_var(line_returns(spark, folder), window)


def scored(spark, folder):
    return tail.mark_breaches(rolled_var(spark, folder))


@query(f"WITH {R_LINE}, {ROLL.format(w=252, b=251, q=Q95)} SELECT series_id, d, round(var, 8) AS var FROM v")
def rolling_hist_var_252(spark, folder):
    return rounded(rolled_var(spark, folder).select("series_id", "d", "var"))


@query(f"WITH {HITS} SELECT series_id, d, round(realised_loss, 8) AS realised_loss, round(var, 8) AS var, round(realised_loss - var, 8) AS excess FROM hit WHERE b = 1")
def breaches(spark, folder):
    return rounded(scored(spark, folder).where("is_breach = 1").select("series_id", "d", "realised_loss", "var", "excess"))


@query(ORACLES["breaches"])
def breaches_joined(spark, folder):
    """The same for estimates that come as a table of their own."""
    r = line_returns(spark, folder)
    found = tail.breaches(r, tail.rolling_historical_var(r, 252).select("series_id", "d", "var"))
    return rounded(found.where("is_breach = 1").select("series_id", "d", "realised_loss", "var", "excess"))


@query(f"WITH {HITS} SELECT series_id, count(*) AS n_days, sum(b)::BIGINT AS n_breaches, round(avg(b), 8) AS observed_rate FROM hit GROUP BY 1")
def breach_rate(spark, folder):
    return rounded(tail.breach_rate(scored(spark, folder)))


@query(f"WITH {HITS}, {RUNS} SELECT series_id, mr::BIGINT AS max_consecutive FROM runs")
def max_consecutive(spark, folder):
    return backtest.longest_runs(scored(spark, folder))


@query(f"WITH {HITS}, {TRANS} SELECT series_id, n AS n_observations, x::BIGINT AS n_breaches, round({KUPIEC}, 6) AS kupiec_statistic, ({KUPIEC}) <= {backtest.LIMIT_1!r} AS passes_coverage FROM t")
def kupiec(spark, folder):
    return rounded(backtest.backtest(scored(spark, folder), p_values=False).select("series_id", "n_observations", "n_breaches", "kupiec_statistic", "passes_coverage"), 6)


@query(f"WITH {HITS}, {TRANS} SELECT series_id, round({CHRIS}, 6) AS christoffersen_statistic, ({CHRIS}) <= {backtest.LIMIT_1!r} AS passes_independence FROM t")
def christoffersen(spark, folder):
    return rounded(backtest.backtest(scored(spark, folder), p_values=False).select("series_id", "christoffersen_statistic", "passes_independence"), 6)


@query(f"WITH {HITS}, {TRANS} SELECT series_id, round({KUPIEC} + {CHRIS}, 6) AS joint_statistic, round(exp(-({KUPIEC} + {CHRIS}) / 2), 6) AS joint_p FROM t")
def joint_coverage(spark, folder):
    return rounded(backtest.backtest(scored(spark, folder)).select("series_id", "joint_statistic", "joint_p"), 6)


@query(
    f"WITH {HITS}, {TRANS}, x AS (SELECT series_id, n, ({KUPIEC})::DOUBLE AS ks, ({CHRIS})::DOUBLE AS cs FROM t), p AS (SELECT series_id, {chi2_tail_sql('ks')} AS kp, {chi2_tail_sql('cs')} AS cp FROM x, {NODES} GROUP BY series_id, ks, cs) "
    f"SELECT series_id, round(kp, 6) AS kupiec_p, round(cp, 6) AS christoffersen_p, round(exp(-(ks + cs) / 2), 6) AS joint_p, CASE WHEN kp >= 0.05 AND cp >= 0.05 THEN 'not rejected' WHEN kp < 0.05 AND cp < 0.05 THEN 'rejected on count and clustering' WHEN kp < 0.05 THEN 'rejected on count' ELSE 'rejected on clustering' END AS verdict FROM x JOIN p USING (series_id)"
)
def coverage_p_values(spark, folder):
    b = backtest.backtest(scored(spark, folder)).withColumn("verdict", F.regexp_replace("verdict", ": too .*", ""))
    return rounded(b.select("series_id", "kupiec_p", "christoffersen_p", "joint_p", "verdict"), 6)


MODELS = f"{R_LINE}, v1 AS (SELECT 'long' AS model, * FROM (WITH {ROLL.format(w=500, b=499, q=Q95)} SELECT * FROM v)), v2 AS (SELECT 'short' AS model, * FROM (WITH {ROLL.format(w=100, b=99, q=Q95)} SELECT * FROM v))"
_by_model = lambda s: s.replace("series_id, ", "series_id, model, ").replace("PARTITION BY series_id", "PARTITION BY series_id, model")
COMPARE = f"{MODELS}, hit AS (SELECT series_id, model, d, CASE WHEN -(exp(r) - 1) > var THEN 1 ELSE 0 END AS b FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2) WHERE var IS NOT NULL), {_by_model(TRANS).replace('GROUP BY 1)', 'GROUP BY 1, 2)')}, {_by_model(RUNS).replace('GROUP BY 1, 2)', 'GROUP BY 1, 2, 3)').replace('GROUP BY 1)', 'GROUP BY 1, 2)')}"


@query(
    f"WITH {COMPARE} SELECT series_id, model, x::BIGINT AS breaches, round(n * {Q95!r}::DOUBLE, 1) AS expected, round(x / n, 8) AS rate, round({KUPIEC}, 6) AS kupiec_statistic, round({CHRIS}, 6) AS christoffersen_statistic, round({KUPIEC} + {CHRIS}, 6) AS joint_statistic, CASE WHEN {KUPIEC} <= {backtest.LIMIT_1!r} THEN 'pass' ELSE 'FAIL' END AS coverage, CASE WHEN {CHRIS} <= {backtest.LIMIT_1!r} THEN 'pass' ELSE 'FAIL' END AS independence, mr::BIGINT AS max_run FROM t JOIN runs USING (series_id, model)"
)
def compare_backtests(spark, folder):
    r = line_returns(spark, folder)
    parts = [tail.rolling_historical_var(r, w).select(F.lit(m).alias("model"), "series_id", "d", "r", "var") for m, w in (("long", 500), ("short", 100))]
    v = parts[0].unionByName(parts[1])
    by = ("series_id", "model")
    c = backtest.compare(tail.mark_breaches(v), by=by, p_values=False)
    return c.select(*by, "breaches", "expected", F.round("rate", 8).alias("rate"), *(F.round(f"{x}_statistic", 6).alias(f"{x}_statistic") for x in ("kupiec", "christoffersen", "joint")), "coverage", "independence", "max_run")


@query(
    f"WITH {HITS}, l AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d DESC) <= 250), z AS (SELECT series_id, sum(b)::BIGINT AS x, count(*) AS n FROM l GROUP BY 1) SELECT series_id, x AS n_breaches, n AS n_days, CASE WHEN x <= 4 * n / 250.0 THEN 'green' WHEN x <= 9 * n / 250.0 THEN 'yellow' ELSE 'red' END AS zone, n = 250 AS exact_window FROM z"
)
def basel_zone(spark, folder):
    return backtest.basel(scored(spark, folder)).select("series_id", "n_breaches", "n_days", "zone", "exact_window")


@query(
    f"WITH {R_LINE}, {ROLL.format(w=252, b=251, q=Q95)}, hit AS (SELECT series_id, CASE WHEN -(exp(r) - 1) > var THEN 1 ELSE 0 END AS b, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS k FROM v WHERE var IS NOT NULL), z AS (SELECT series_id, sum(b) FILTER (k <= 250)::BIGINT AS x FROM hit GROUP BY 1) "
    "SELECT series_id, round(stddev_samp(r) * sqrt(252), 7) AS annualised, count(*) AS n_observations, any_value(n) AS n_days, any_value(x) AS recent_breaches FROM rets JOIN (SELECT series_id, count(*) AS n FROM hit GROUP BY 1) USING (series_id) JOIN z USING (series_id) GROUP BY 1"
)
def session_views(spark, folder):
    """Three views of one session: prices, returns and the scored days are computed once for all of them."""
    v = views.Views(spark, lambda: panels.line_prices(spark, folder))
    days = v.backtests(0.95, 252).select("series_id", F.col("n_observations").alias("n_days"))
    zones = v.zones(0.95, 252).select("series_id", F.col("n_breaches").alias("recent_breaches"))
    return rounded(v.overview().select("series_id", "annualised", "n_observations").join(days, "series_id").join(zones, "series_id"), 7)


# --- Quality ---------------------------------------------------------------------------------


def raw_prices(spark, folder):
    o = spark.read.parquet(f"{folder}/orders.parquet")
    k = F.col("o_orderkey")
    close = F.when(k % 89 == 0, F.lit(None)).when(k % 97 == 0, dbl(-1)).otherwise(F.col("o_totalprice"))
    return o.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("d"), close.alias("close"), close.alias("adj_close"), F.lit(1).cast("bigint").alias("volume"), k.alias("ingest_seq"))


def report(spark, folder):
    return sources.quality_report(raw_prices(spark, folder), F.lit(NOW).cast("timestamp"))


@query(
    f"WITH {KEPT}, a AS (SELECT series_id, count(*) - count(DISTINCT d) AS dup FROM raw GROUP BY 1), o AS (SELECT series_id, bool_or(d < pd) AS uno, count(*) FILTER (d > TIMESTAMP '{NOW}') AS fut FROM (SELECT *, lag(d) OVER (PARTITION BY series_id ORDER BY ingest_seq) AS pd FROM kept) GROUP BY 1), "
    "b AS (SELECT series_id, count(*) FILTER (dayofweek(d) IN (0, 6)) AS we, count(*) FILTER (gap > 7) AS lg, max(gap) FILTER (gap > 7) AS mg, count(*) FILTER (close IS NULL OR close <= 0) AS bad, median(gap) AS tg FROM past GROUP BY 1), "
    "c AS (SELECT series_id, count(*) FILTER (abs(move) > 0.3) AS ext, array_to_string(list_sort(list(CAST(d AS VARCHAR)) FILTER (abs(move) > 0.3))[:5], ',') AS xd, count(*) AS n, min(d) AS fd, max(d) AS ld FROM good GROUP BY 1) "
    "SELECT series_id, concat_ws('; ', CASE WHEN dup > 0 THEN dup || ' duplicate dates' END, CASE WHEN uno THEN 'dates out of order' END, CASE WHEN fut > 0 THEN fut || ' future rows' END, CASE WHEN bad > 0 THEN bad || ' bad prices' END) AS issues, "
    "concat_ws('; ', CASE WHEN we > 0 THEN we || ' weekend rows' END, CASE WHEN lg > 0 THEN lg || ' large gaps' END, CASE WHEN ext > 0 THEN ext || ' extreme moves' END) AS warnings, "
    "concat_ws('; ', CASE WHEN tg > 4 THEN 'too sparse' END, CASE WHEN n < 30 THEN 'too few observations' END) AS blocking, coalesce(xd, '') AS extreme_dates, dup AS n_duplicates, uno AS is_unordered, fut AS n_future, we AS n_weekend, lg AS n_large_gaps, mg::INT AS max_gap_days, bad AS n_bad_prices, ext AS n_extreme, tg::DOUBLE AS typical_gap, n AS n_observations, fd AS first_day, ld AS last_day, NOT (coalesce(tg > 4, false) OR n < 30) AS usable FROM a JOIN o USING (series_id) JOIN b USING (series_id) JOIN c USING (series_id)"
)
def quality_report(spark, folder):
    r = report(spark, folder)
    return r.withColumns({**{c: F.array_join(c, "; ") for c in ("issues", "warnings", "blocking")}, "extreme_dates": F.array_join(r.extreme_dates.cast("array<string>"), ",")})


@query(f"WITH {KEPT} SELECT series_id, d, close, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS ingest_seq, 'all' AS period, TIMESTAMP '{NOW}' AS fetched_at FROM good")
def envelope_round_trip(spark, folder):
    """Cleaned prices written as envelope files, one a series, and read again."""
    path = f"{shared_dir(spark)}/tailframe-envelopes-{uuid.uuid4().hex}"
    good = sources.clean_prices(raw_prices(spark, folder), F.lit(NOW).cast("timestamp"))
    envelope.write_envelopes(good, path, "all", f"{NOW}+00:00")
    got = envelope.read_envelopes(spark, path)
    return got.select("series_id", "d", "close", "ingest_seq", "period", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"))


@query(f"WITH {KEPT} SELECT series_id, d, close, ingest_seq FROM good")
def clean_prices(spark, folder):
    return sources.clean_prices(raw_prices(spark, folder), F.lit(NOW).cast("timestamp")).select("series_id", "d", "close", "ingest_seq")


RARE = KEPT.replace("o_orderpriority AS series_id", "CASE WHEN o_orderkey % 50 = 1 THEN 'rare' ELSE o_orderpriority END AS series_id")


def rare_prices(spark, folder):
    """The same with a series of few days, which validation refuses."""
    o = raw_prices(spark, folder)
    return o.withColumn("series_id", F.when(F.col("ingest_seq") % 50 == 1, "rare").otherwise(F.col("series_id")))


@query(f"WITH {RARE}, ok AS (SELECT series_id FROM past GROUP BY 1 HAVING NOT coalesce(median(gap) > 4, false)), en AS (SELECT series_id FROM good GROUP BY 1 HAVING count(*) >= 30) SELECT series_id, d, close, ingest_seq FROM good WHERE series_id IN (SELECT series_id FROM ok) AND series_id IN (SELECT series_id FROM en)")
def validated_prices(spark, folder):
    return sources.validated(rare_prices(spark, folder), F.lit(NOW).cast("timestamp"), strict=False).select("series_id", "d", "close", "ingest_seq")


@query(
    f"WITH {RARE}, ls AS (SELECT DISTINCT series_id FROM raw UNION ALL SELECT 'absent'), b AS (SELECT series_id, median(gap) AS tg FROM past GROUP BY 1), c AS (SELECT series_id, count(*) AS n FROM good GROUP BY 1) "
    "SELECT ls.series_id, coalesce(n, 0) AS n_observations, concat_ws('; ', CASE WHEN b.series_id IS NULL THEN 'no data' END, CASE WHEN tg > 4 THEN 'too sparse' END, CASE WHEN b.series_id IS NOT NULL AND coalesce(n, 0) < 30 THEN 'too few observations' END) AS blocking FROM ls LEFT JOIN b USING (series_id) LEFT JOIN c USING (series_id)"
)
def blocked_series(spark, folder):
    """What refuses a series, with one asked for that has no rows at all."""
    p = rare_prices(spark, folder)
    asked = p.select("series_id").distinct().unionByName(spark.createDataFrame([("absent",)], "series_id string"))
    r = sources.quality_report(p, F.lit(NOW).cast("timestamp"), asked)
    return r.select("series_id", "n_observations", F.array_join("blocking", "; ").alias("blocking"))


@query(f"WITH {KEPT} SELECT series_id, d, round(move, 8) AS move FROM good WHERE abs(move) > 0.3")
def extreme_moves(spark, folder):
    r = returns.simple_returns(sources.clean_prices(raw_prices(spark, folder), F.lit(NOW).cast("timestamp")), price="close")
    return rounded(r.where(F.abs("r") > S.EXTREME_MOVE).select("series_id", "d", F.col("r").alias("move")))


@query(f"WITH {KEPT} SELECT series_id, count(*) FILTER (gap > 7) AS n_large_gaps, max(gap) FILTER (gap > 7)::INT AS max_gap_days FROM past GROUP BY 1")
def large_gaps(spark, folder):
    return report(spark, folder).select("series_id", "n_large_gaps", "max_gap_days")


@query("SELECT event_type, max(ts)::TIMESTAMP AS fetched_at, CASE WHEN max(ts) >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOURS THEN 'DELAYED' ELSE 'STALE' END AS freshness FROM events GROUP BY 1")
def freshness_by_type(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").agg(F.max("ts").alias("fetched_at"))
    return e.withColumn("freshness", freshness("fetched_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")))


@query("SELECT p_partkey, translate('^' || p_name || '/' || p_brand, '^/', '__') AS cache_name FROM part")
def cache_names(spark, folder):
    p = spark.read.parquet(f"{folder}/part.parquet")
    return p.select("p_partkey", cache_safe(F.concat(F.lit("^"), "p_name", F.lit("/"), "p_brand")).alias("cache_name"))


# --- Portfolios ------------------------------------------------------------------------------


def weights(spark):
    rows = [("P1", "A", 0.5), ("P1", "N", 0.3), ("P1", "R", 0.2), ("P2", "A", 2.0), ("P2", "R", -1.0)]
    return spark.createDataFrame(rows, "portfolio_id string, series_id string, w double")


def panel(spark, folder):
    return portfolio.aligned(line_returns(spark, folder), weights(spark))


@query(f"WITH {PANEL} SELECT portfolio_id, series_id, d, round(s, 8) AS s, round(w, 8) AS w FROM pn")
def aligned_panel(spark, folder):
    return rounded(panel(spark, folder))


@query(f"WITH {PANEL}, {COV} SELECT portfolio_id, i, j, round(cov, 5) AS cov, round(corr, 7) AS corr FROM cv WHERE i <= j")
def covariance_pairs(spark, folder):
    c = portfolio.covariance_pairs(panel(spark, folder))
    return c.select("portfolio_id", "i", "j", F.round("cov", 5).alias("cov"), F.round("corr", 7).alias("corr"))


def contribution(spark, folder):
    return portfolio.contributions(portfolio.covariance_pairs(panel(spark, folder)))


@query(f"WITH {PANEL}, {COV}, {CONTRIB} SELECT DISTINCT portfolio_id, round(vol, 6) AS annualised_volatility FROM cb")
def portfolio_vol(spark, folder):
    return rounded(contribution(spark, folder).groupBy("portfolio_id").agg(F.max("portfolio_volatility").alias("annualised_volatility")), 6)


@query(f"WITH {PANEL}, {COV}, {CONTRIB} SELECT portfolio_id, series_id, round(w, 8) AS w, round(own, 6) AS own_volatility, round(m / vol, 6) AS marginal, round(w * m / vol, 6) AS contribution, round(w * m / vol / vol, 7) AS share FROM cb")
def risk_contribution(spark, folder):
    c = contribution(spark, folder)
    digits = {"w": 8, "share": 7}
    return c.select("portfolio_id", "series_id", *(F.round(x, digits.get(x, 6)).alias(x) for x in ("w", "own_volatility", "marginal", "contribution", "share")))


@query(
    f"WITH {PANEL}, {COV}, {CONTRIB}, z AS (SELECT portfolio_id, count(*) AS n, sum(w * w) AS h, sum(abs(w) * own) AS wv, max(vol) AS v, arg_max(series_id, abs(w)) AS hv FROM cb GROUP BY 1) SELECT portfolio_id, n AS n_holdings, round(h, 8) AS herfindahl, round(1 / h, 8) AS effective_holdings, hv AS heaviest, round(wv, 6) AS weighted_average_volatility, round(wv / v, 7) AS diversification_ratio, round(1 - v / wv, 7) AS risk_reduction, 1 / h < n * 0.5 AS is_concentrated FROM z"
)
def concentration(spark, folder):
    c = portfolio.concentration(contribution(spark, folder))
    digits = {"herfindahl": 8, "effective_holdings": 8, "weighted_average_volatility": 6}
    return c.select("portfolio_id", "n_holdings", *(F.round(x, digits.get(x, 7)).alias(x) for x in ("herfindahl", "effective_holdings", "weighted_average_volatility", "diversification_ratio", "risk_reduction")), "heaviest", "is_concentrated")


@query(
    f"WITH {PANEL}, {DAILY}, e AS (SELECT *, r - 0.02::DOUBLE / 252 AS x FROM dy), a AS (SELECT portfolio_id, count(*) AS n, avg(r) AS mr, avg(x) AS me, stddev_samp(r) AS sd, sqrt(avg(pow(least(x, 0), 2))) AS dn FROM e GROUP BY 1) SELECT portfolio_id, n AS n_observations, round(mr * 252, 6) AS annualised_return, round(me / sd * sqrt(252), 6) AS sharpe, round(me / dn * sqrt(252), 6) AS sortino FROM a"
)
def sharpe_sortino(spark, folder):
    return rounded(portfolio.ratios(panel(spark, folder), 0.02).drop("max_drawdown"), 6)


@query(
    f"WITH {PANEL}, {DAILY}, c AS (SELECT portfolio_id, d, product(1 + r) OVER (PARTITION BY portfolio_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS l FROM dy), k AS (SELECT *, l / max(l) OVER (PARTITION BY portfolio_id ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c) SELECT portfolio_id, round(min(dd), 6) AS max_drawdown FROM k GROUP BY 1"
)
def portfolio_max_drawdown(spark, folder):
    return rounded(portfolio.ratios(panel(spark, folder)).select("portfolio_id", "max_drawdown"), 6)


@query(f"WITH {PANEL}, {DAILY} SELECT portfolio_id AS series_id, d, round(ln(1 + r), 7) AS r FROM dy WHERE r > -1")
def portfolio_log_returns(spark, folder):
    return rounded(portfolio.log_series(panel(spark, folder)), 7)


@query(f"WITH {PANEL}, q AS (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS v FROM rets GROUP BY 1) SELECT portfolio_id, round(sum(abs(w) * v), 7) AS component_var FROM nw JOIN q USING (series_id) GROUP BY 1")
def component_var_sum(spark, folder):
    return rounded(portfolio.component_var_sum(tail.historical_var(line_returns(spark, folder)), weights(spark)), 7)


BLEND = f"{PANEL}, {COV}".replace(", wts AS", ", rets2 AS (SELECT * FROM rets UNION ALL SELECT 'A+', d, (9 * a.r + n.r) / 10 FROM rets a JOIN rets n USING (d) WHERE a.series_id = 'A' AND n.series_id = 'N'), wts AS").replace("FROM rets JOIN nw", "FROM rets2 JOIN nw").replace("('P1', 'A', 0.5),", "('P1', 'A+', 0.5), ('P1', 'A', 0.5),")


@query(f"WITH {BLEND} SELECT portfolio_id, i, j, round(corr, 7) AS corr FROM cv WHERE i < j AND corr > 0.9")
def duplicate_bets(spark, folder):
    """With a blend of nine parts A and one part N beside A, which is nearly the same bet."""
    r = line_returns(spark, folder).select("series_id", "d", "r")
    a, n = (r.where(F.col("series_id") == s).select("d", F.col("r").alias(s)) for s in "AN")
    blend = a.join(n, "d").select(F.lit("A+").alias("series_id"), "d", ((9 * F.col("A") + F.col("N")) / 10).alias("r"))
    w = weights(spark).unionByName(spark.createDataFrame([("P1", "A+", 0.5)], "portfolio_id string, series_id string, w double"))
    return rounded(portfolio.same_bets(portfolio.covariance_pairs(portfolio.aligned(r.unionByName(blend), w))), 7)


@query("SELECT DISTINCT 'ALL' AS portfolio_id, l_returnflag AS series_id, round(1.0::DOUBLE / 3, 8) AS w FROM lineitem")
def equal_weights(spark, folder):
    members = panels.line_prices(spark, folder).select(F.lit("ALL").alias("portfolio_id"), "series_id").distinct()
    return rounded(portfolio.equal_weights(members))


@query("SELECT 'P3' AS portfolio_id, 'missing' AS series_id")
def missing_members(spark, folder):
    extra = spark.createDataFrame([("P3", "missing", 1.0)], "portfolio_id string, series_id string, w double")
    return portfolio.missing_members(weights(spark).unionByName(extra), line_returns(spark, folder))


@query(f"WITH {PANEL}, {COV}, m AS (SELECT max(CASE WHEN i = 'A' AND j = 'A' THEN cov END) AS aa, max(CASE WHEN i = 'R' AND j = 'R' THEN cov END) AS rr, max(CASE WHEN i = 'A' AND j = 'R' THEN cov END) AS ar FROM cv WHERE portfolio_id = 'P2') SELECT s AS series_id, round(CASE s WHEN 'A' THEN (rr - ar) / (aa + rr - 2 * ar) ELSE (aa - ar) / (aa + rr - 2 * ar) END, 7) AS w FROM m, (VALUES ('A'), ('R')) t(s)")
def min_variance_two_asset(spark, folder):
    pairs = portfolio.covariance_pairs(panel(spark, folder)).where("portfolio_id = 'P2'")
    return rounded(portfolio.minimum_variance(pairs).select("series_id", "w"), 7)


_cv = lambda i, j: f"max(CASE WHEN i = '{min(i, j)}' AND j = '{max(i, j)}' THEN cov END)"


@query(
    f"WITH {PANEL}, {COV}, m AS (SELECT portfolio_id, {', '.join(f'{_cv(i, j)} AS {i}{j}' for i, j in ('AA', 'NN', 'RR', 'AN', 'AR', 'NR'))} FROM cv GROUP BY 1), "
    "x AS (SELECT portfolio_id, nn * rr - nr * nr + ar * nr - an * rr + an * nr - nn * ar AS a, ar * nr - an * rr + aa * rr - ar * ar + an * ar - aa * nr AS n, an * nr - nn * ar + an * ar - aa * nr + aa * nn - an * an AS r FROM m WHERE portfolio_id = 'P1' "
    "UNION ALL SELECT portfolio_id, rr - ar, NULL, aa - ar FROM m WHERE portfolio_id = 'P2') "
    "SELECT portfolio_id, s AS series_id, round(CASE s WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END / (a + coalesce(n, 0) + r), 6) AS w FROM x, (VALUES ('A'), ('N'), ('R')) t(s) WHERE s <> 'N' OR n IS NOT NULL"
)
def min_variance(spark, folder):
    """In SQL by the adjugate of the covariance matrix, times ones."""
    return rounded(portfolio.minimum_variance(portfolio.covariance_pairs(panel(spark, folder))).select("portfolio_id", "series_id", "w"), 6)


ANALYSED = {"herfindahl": 8, "effective_holdings": 8, "heaviest_weight": 8, "weighted_average_volatility": 6, "annualised_volatility": 6, "annualised_return": 6, "sharpe": 6, "sortino": 6, "max_drawdown": 6, "diversification_ratio": 6, "risk_reduction": 6}


@query(
    f"WITH {PANEL}, {COV}, {CONTRIB}, {DAILY}, z AS (SELECT portfolio_id, count(*) AS n, sum(w * w) AS h, sum(abs(w) * own) AS wv, max(vol) AS v, arg_max(series_id, abs(w)) AS hv, max(abs(w)) AS hw, string_agg(printf('%s:%.4f:%.4f', series_id, w, w * m / vol / vol), ',' ORDER BY series_id) AS ms, count(*) FILTER (w * m < 0) AS hedges, count(*) FILTER (w < 0) AS shorts FROM cb GROUP BY 1), "
    "a AS (SELECT portfolio_id, count(*) AS no, avg(r) AS mr, stddev_samp(r) AS sd, sqrt(avg(pow(least(r, 0), 2))) AS dn FROM dy GROUP BY 1), "
    "c AS (SELECT portfolio_id, d, product(1 + r) OVER (PARTITION BY portfolio_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS l FROM dy), k AS (SELECT portfolio_id, min(l / hl - 1) AS md FROM (SELECT *, max(l) OVER (PARTITION BY portfolio_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS hl FROM c) GROUP BY 1), "
    "sb AS (SELECT portfolio_id, string_agg(i || '=' || j, ',' ORDER BY i, j) AS bets FROM cv WHERE i < j AND corr > 0.9 GROUP BY 1) "
    "SELECT portfolio_id, n AS n_holdings, round(h, 8) AS herfindahl, hv AS heaviest, round(hw, 8) AS heaviest_weight, round(wv, 6) AS weighted_average_volatility, round(v, 6) AS annualised_volatility, round(1 / h, 8) AS effective_holdings, round(wv / v, 6) AS diversification_ratio, round(1 - v / wv, 6) AS risk_reduction, 1 / h < n * 0.5 AS is_concentrated, "
    "no AS n_observations, round(mr * 252, 6) AS annualised_return, round(mr / sd * sqrt(252), 6) AS sharpe, round(mr / dn * sqrt(252), 6) AS sortino, round(md, 6) AS max_drawdown, ms AS members, coalesce(bets, '') AS same_bets, "
    "concat_ws('; ', CASE WHEN 1 / h < n * 0.5 THEN 'concentrated in ' || hv END, CASE WHEN bets IS NOT NULL THEN 'members that are nearly the same bet' END, CASE WHEN hedges > 0 THEN 'members that lower the risk' END, CASE WHEN shorts > 0 THEN 'short positions' END, CASE WHEN mr / dn > mr / sd * 1.3 THEN 'much of the volatility is upside' END) AS notes "
    "FROM z JOIN a USING (portfolio_id) JOIN k USING (portfolio_id) LEFT JOIN sb USING (portfolio_id)"
)
def portfolio_analysis(spark, folder):
    p = portfolio.analyse(line_returns(spark, folder), weights(spark))
    members = F.array_join(F.transform("members", lambda m: F.format_string("%s:%.4f:%.4f", m["series_id"], m["w"], m["share"])), ",")
    bets = F.array_join(F.transform("same_bets", lambda b: F.concat_ws("=", b["i"], b["j"])), ",")
    nested = {"members": members, "same_bets": F.coalesce(bets, F.lit("")), "notes": F.array_join("notes", "; ")}
    return p.withColumns({**{c: F.round(c, n) for c, n in ANALYSED.items()}, **nested})


# --- Scorecards ------------------------------------------------------------------------------


def fundamentals(spark, folder):
    return scorecard.fundamental(panels.nation_ratios(spark, folder))


PILLARS = ["leverage_risk", "liquidity_risk", "earnings_quality_risk", "deterioration_risk", "overall_risk"]


@query(f"WITH {FUND} SELECT entity, fiscal_year::INT AS last_year, {', '.join(f'round({c}, 6) AS {c}' for c in PILLARS)}, {RATING('overall_risk')} AS rating FROM fu")
def fundamental_pillars(spark, folder):
    return rounded(fundamentals(spark, folder).select("entity", "last_year", *PILLARS, "rating"), 6)


FLAGS = [
    ("interest_coverage < 2.0", "Leverage", "critical", "interest_coverage"),
    ("interest_coverage >= 2.0 AND interest_coverage < 4.0", "Leverage", "elevated", "interest_coverage"),
    ("debt_to_equity > 3.0", "Leverage", "critical", "debt_to_equity"),
    ("current_ratio < 0.8", "Liquidity", "critical", "current_ratio"),
    ("current_ratio >= 0.8 AND current_ratio < 1.0", "Liquidity", "watch", "current_ratio"),
    ("sus < 0.6", "Earnings quality", "critical", "sus"),
    ("sus >= 0.6 AND sus < 0.8", "Earnings quality", "elevated", "sus"),
    ("fcf_margin < 0", "Cash generation", "elevated", "fcf_margin"),
    ("s_interest_coverage < -1.0", "Deterioration", "elevated", "s_interest_coverage"),
    ("s_ebitda_margin < -0.02", "Deterioration", "elevated", "s_ebitda_margin"),
    ("s_debt_to_equity > 0.3", "Deterioration", "elevated", "s_debt_to_equity"),
]


@query(f"WITH {FUND} " + " UNION ALL ".join(f"SELECT entity, '{c}' AS category, '{s}' AS severity, round({e}, 6) AS evidence FROM fu WHERE {w}" for w, c, s, e in FLAGS))
def fundamental_flags(spark, folder):
    f = fundamentals(spark, folder).select("entity", F.explode("flags").alias("f"))
    return f.select("entity", "f.category", "f.severity", F.round("f.evidence", 6).alias("evidence"))


@query(
    f"WITH {FUND}, z AS (SELECT entity, overall_risk, {sc('0.10::DOUBLE + CAST(entity AS INT) * 0.02::DOUBLE', 0.15, 0.55)} AS market_risk FROM fu) SELECT entity, round(market_risk, 6) AS market_risk, round(overall_risk - market_risk, 6) AS gap, CASE WHEN overall_risk - market_risk > 25 THEN 'fundamental risk exceeds market risk' WHEN overall_risk - market_risk < -25 THEN 'market risk exceeds fundamental risk' ELSE 'the two measures broadly agree' END AS verdict FROM z"
)
def fundamental_vs_market(spark, folder):
    f = fundamentals(spark, folder).withColumn("volatility", dbl(0.10) + F.col("entity").cast("int") * dbl(0.02))
    return rounded(scorecard.compare_with_market(f).select("entity", "market_risk", "gap", "verdict"), 6)


@query(
    f"WITH {FUND}, w AS (SELECT entity, overall_risk, 0.10::DOUBLE + CAST(entity AS INT) * 0.02::DOUBLE AS vol, CASE WHEN CAST(entity AS INT) % 4 = 0 THEN 0 WHEN CAST(entity AS INT) % 4 = 1 THEN NULL ELSE 0.05::DOUBLE * (CAST(entity AS INT) % 7 + 1) END AS peer FROM fu), "
    f"z AS (SELECT *, CASE WHEN peer > 0 THEN greatest(0, least(2, vol / nullif(peer, 0))) / 2 * 100 ELSE {sc('vol', 0.15, 0.55)} END AS market_risk FROM w) SELECT entity, round(market_risk, 6) AS market_risk, round(overall_risk - market_risk, 6) AS gap, CASE WHEN overall_risk - market_risk > 25 THEN 'fundamental risk exceeds market risk' WHEN overall_risk - market_risk < -25 THEN 'market risk exceeds fundamental risk' ELSE 'the two measures broadly agree' END AS verdict FROM z"
)
def fundamental_vs_peers(spark, folder):
    """Against a peer group's volatility; without one (missing or zero) against the usual range."""
    k = F.col("entity").cast("int")
    peer = F.when(k % 4 == 0, dbl(0)).when(k % 4 == 1, F.lit(None).cast("double")).otherwise(dbl(0.05) * (k % 7 + 1))
    f = fundamentals(spark, folder).withColumn("volatility", dbl(0.10) + k * dbl(0.02)).withColumn("peer", peer)
    return rounded(scorecard.compare_with_market(f, peer="peer").select("entity", "market_risk", "gap", "verdict"), 6)


@query(f"WITH {RATIOS}, {SLOPE} SELECT entity, metric, n_years, round(slope, 7) AS slope, CASE WHEN slope IS NULL THEN 'unknown' WHEN (CASE metric WHEN 'debt_to_equity' THEN -slope ELSE slope END) > 0 THEN 'improving' WHEN (CASE metric WHEN 'debt_to_equity' THEN -slope ELSE slope END) < 0 THEN 'worsening' ELSE 'flat' END AS trend FROM sl")
def trend_slopes(spark, folder):
    s = scorecard.slopes(scorecard.recent_years(panels.nation_ratios(spark, folder)))
    word = F.when(F.col("metric") == "debt_to_equity", trend_label("slope", True)).otherwise(trend_label("slope"))
    return s.select("entity", "metric", "n_years", F.round("slope", 7).alias("slope"), word.alias("trend"))


# --- Valuation -------------------------------------------------------------------------------


@query(f"WITH {SUP} SELECT entity, dw AS d_wacc, dg AS d_growth, round({dcf_sql('wacc + dw', 'g + dg')}, 6) AS price FROM su, (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in S.GRID_STEPS)}) a(dw), (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in S.GRID_STEPS)}) c(dg)")
def valuation_grid(spark, folder):
    g = valuation.grid(panels.supplier_valuations(spark, folder))
    return g.select("entity", "d_wacc", "d_growth", F.round("price", 6).alias("price"))


def assessed(spark, folder):
    base = panels.supplier_valuations(spark, folder)
    return valuation.assess(base.withColumn("market_implied_wacc", F.col("wacc") - dbl(0.001) * (F.col("entity").cast("int") % 60)))


@query(
    f"WITH {SUP}, {SENS} SELECT entity, round(implied, 6) AS implied_price, round(implied / price - 1, 7) AS upside, round(tshare, 7) AS terminal_share, round(wsens, 7) AS wacc_sensitivity, round(gsens, 7) AS growth_sensitivity, coalesce(abs(wsens) > 0.05, false) AS is_fragile, CASE WHEN tshare >= 0.85 THEN 'Critical' WHEN tshare >= 0.70 THEN 'High' WHEN tshare >= 0.5 THEN 'Moderate' ELSE 'Low' END AS assumption_dependence FROM vz"
)
def valuation_sensitivity(spark, folder):
    a = assessed(spark, folder)
    return a.select("entity", F.round("implied_price", 6).alias("implied_price"), *(F.round(c, 7).alias(c) for c in ("upside", "terminal_share", "wacc_sensitivity", "growth_sensitivity")), "is_fragile", "assumption_dependence")


@query(
    f"WITH {SUP}, z AS (SELECT su.*, sn, dw, dg, {dcf_sql('wacc', 'g')} AS base, {dcf_sql('wacc + dw', 'g + dg')} AS val FROM su, (VALUES {', '.join(f'({n!r}, {w!r}::DOUBLE, {x!r}::DOUBLE)' for n, w, x in S.SCENARIOS)}) t(sn, dw, dg)) SELECT entity, sn AS scenario, round(wacc + dw, 8) AS scenario_wacc, round(g + dg, 8) AS scenario_growth, round(val, 6) AS implied_price, round(CASE WHEN base > 0 THEN val / base - 1 END, 7) AS vs_base, round(val / price - 1, 7) AS vs_market FROM z"
)
def stress_scenarios(spark, folder):
    s = valuation.stress(panels.supplier_valuations(spark, folder))
    digits = {"implied_price": 6, "vs_base": 7, "vs_market": 7}
    return s.select("entity", "scenario", *(F.round(c, digits.get(c, 8)).alias(c) for c in s.columns[2:]))


IMPLIED_G = f"((50 * price + debt - {pv_sql('wacc')}) * pow(1 + wacc, 5) * wacc / (b * {1.0 + 5 * 0.03!r}::DOUBLE) - 1) / (1 + (50 * price + debt - {pv_sql('wacc')}) * pow(1 + wacc, 5) / (b * {1.0 + 5 * 0.03!r}::DOUBLE))"


@query(f"WITH {SUP}, z AS (SELECT *, {IMPLIED_G} AS x, {dcf_sql('wacc', '-0.05::DOUBLE')} AS lo, {dcf_sql('wacc', 'wacc - 0.006::DOUBLE')} AS hi FROM su) SELECT entity, round(CASE WHEN lo <= price AND price <= hi THEN x END, 7) AS market_implied_growth FROM z")
def implied_growth(spark, folder):
    """With this pricer the root has a closed form, which the SQL uses; the operator bisects."""
    a = assessed(spark, folder)
    return a.select("entity", F.round("market_implied_growth", 7).alias("market_implied_growth"))


@query(
    f"WITH {SUP}, {SENS}, ig AS (SELECT entity, CASE WHEN lo <= price AND price <= hi THEN x END AS ig FROM (SELECT *, {IMPLIED_G} AS x, {dcf_sql('wacc', '-0.05::DOUBLE')} AS lo, {dcf_sql('wacc', 'wacc - 0.006::DOUBLE')} AS hi FROM su)), fg AS (SELECT vz.*, ig, abs(wacc - nullif({IMPLIED}, 0)) AS wgap FROM vz JOIN ig USING (entity)) "
    "SELECT entity, concat_ws('; ', CASE WHEN tshare >= 0.85 THEN 'nearly all value is beyond the forecast' END, CASE WHEN tshare >= 0.70 AND tshare < 0.85 THEN 'most value is beyond the forecast' END, CASE WHEN abs(wsens) > 0.05 THEN '25 basis points move the price a lot' END, CASE WHEN wgap > 0.02 THEN 'the market implies another discount rate' END, CASE WHEN ig > 0.05 THEN 'the market implies growth above the economy''s' END) AS flags FROM fg WHERE abs(wgap - 0.02) > 1e-9"
)
def valuation_flags(spark, folder):
    """Without the suppliers whose rates differ by exactly the limit, where rounding decides."""
    a = assessed(spark, folder).where(F.coalesce(F.abs(F.abs(F.col("wacc") - F.col("market_implied_wacc")) - 0.02) > 1e-9, F.lit(False)))
    return a.select("entity", F.array_join("flags", "; ").alias("flags"))


@query(f"WITH {SUP}, {SENS}, {VSCORE} SELECT entity, round(v1, 6) AS dependence_score, round(v2, 6) AS fragility_score, round(v3, 5) AS gap_score, round(vscore, 5) AS valuation_score FROM vx")
def valuation_score(spark, folder):
    v = scorecard.score_valuation(assessed(spark, folder))
    return v.select("entity", F.round("dependence_score", 6).alias("dependence_score"), F.round("fragility_score", 6).alias("fragility_score"), F.round("gap_score", 5).alias("gap_score"), F.round("valuation_score", 5).alias("valuation_score"))


# --- Composite -------------------------------------------------------------------------------


def market(spark, folder):
    return scorecard.score_market(composite.market_measures(panels.line_prices(spark, folder), panels.benchmark_prices(spark, folder)))


@query(f"WITH {MARKET} SELECT series_id, round(volatility, 7) AS volatility, round(var_99, 7) AS var_99, round(max_drawdown, 7) AS max_drawdown, round(beta, 6) AS beta, conf AS beta_confidence, regime, round(mscore, 5) AS market_score FROM mk")
def market_score(spark, folder):
    m = market(spark, folder)
    digits = {"beta": 6, "market_score": 5}
    return m.select("series_id", *(F.round(c, digits.get(c, 7)).alias(c) for c in ("volatility", "var_99", "max_drawdown", "beta", "market_score")), "beta_confidence", "regime")


def entity_of(series):
    """The three series stand for entities: 5 has annual ratios and a valuation, 0 has no valuation, 30 no ratios."""
    return F.when(series == "A", "5").when(series == "N", "0").otherwise("30")


def valued(spark, folder):
    """The suppliers' valuations, for entities that count from 2."""
    return assessed(spark, folder).withColumn("entity", (F.col("entity").cast("int") + 2).cast("string"))


def composed(spark, folder):
    m = market(spark, folder).withColumn("entity", entity_of(F.col("series_id")))
    return scorecard.compose(m, fundamentals(spark, folder), valued(spark, folder))


DIMENSIONS = [("market", "mscore", 0.40), ("fundamental", "fscore", 0.30), ("valuation", "vscore", 0.30)]
COMPOSE = (
    f"{MARKET}, {FUND}, {SUP}, {SENS}, {VSCORE}, mc AS (SELECT *, CASE series_id WHEN 'A' THEN '5' WHEN 'N' THEN '0' ELSE '30' END AS entity FROM mk), "
    "al3 AS (SELECT mc.entity, mscore, volatility, regime, fx.entity AS fe, fx.overall_risk AS fscore, fx.deterioration_risk AS det, vv.entity AS ve, vv.vscore, vv.tshare, coalesce(abs(vv.wsens) > 0.05, false) AS frag FROM mc LEFT JOIN fu fx ON mc.entity = fx.entity LEFT JOIN (SELECT * REPLACE (CAST(CAST(entity AS INT) + 2 AS VARCHAR) AS entity) FROM vx) vv ON mc.entity = vv.entity), "
    f"ov AS (SELECT *, {weighted_of([('mscore', 0.40), ('fscore', 0.30), ('vscore', 0.30)])} AS overall, fscore - {sc('volatility', 0.15, 0.55)} AS gp FROM al3)"
)


@query(f"WITH {COMPOSE} SELECT entity, round(overall, 5) AS overall, {RATING('overall')} AS rating, concat_ws(',', CASE WHEN fe IS NULL THEN 'fundamental' END, CASE WHEN ve IS NULL THEN 'valuation' END) AS excluded FROM ov")
def composite_score(spark, folder):
    c = composed(spark, folder)
    return c.select("entity", F.round("overall", 5).alias("overall"), "rating", F.array_join("excluded_dimensions", ",").alias("excluded"))


@query(
    f"WITH {COMPOSE} SELECT entity, 'fundamental_vs_market' AS kind, CASE WHEN gp > 25 THEN 'critical' ELSE 'note' END AS severity FROM ov WHERE abs(gp) > 25 UNION ALL SELECT entity, 'valuation_vs_regime', 'elevated' FROM ov WHERE ve IS NOT NULL AND frag AND regime = 'elevated' UNION ALL SELECT entity, 'deteriorating_vs_terminal', 'elevated' FROM ov WHERE det > 50 AND tshare > 0.7"
)
def divergences(spark, folder):
    return composed(spark, folder).select("entity", F.explode("divergences").alias("v")).select("entity", "v.kind", "v.severity")


USED = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN printf('{k}:%.5f', {w!r}::DOUBLE / ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE {y!r}::DOUBLE END' for _, x, y in DIMENSIONS)})) END" for k, c, w in DIMENSIONS) + ")"


@query(
    f"WITH {COMPOSE} SELECT entity, round(overall, 5) AS overall, {RATING('overall')} AS rating, {USED} AS weights_used, concat_ws(',', CASE WHEN fe IS NULL THEN 'fundamental' END, CASE WHEN ve IS NULL THEN 'valuation' END) AS excluded, "
    "concat_ws(',', CASE WHEN fe IS NOT NULL AND gp > 25 THEN 'fundamental_vs_market:critical' WHEN fe IS NOT NULL AND gp < -25 THEN 'fundamental_vs_market:note' END, CASE WHEN ve IS NOT NULL AND frag AND regime = 'elevated' THEN 'valuation_vs_regime:elevated' END, CASE WHEN det > 50 AND tshare > 0.7 THEN 'deteriorating_vs_terminal:elevated' END) AS divergences FROM ov"
)
def composite_assessment(spark, folder):
    prices = panels.line_prices(spark, folder).withColumn("series_id", entity_of(F.col("series_id")))
    c = composite.assess(prices, panels.benchmark_prices(spark, folder), panels.nation_ratios(spark, folder), valued(spark, folder))
    used = F.array_join(F.transform(F.map_entries("weights_used"), lambda e: F.format_string("%s:%.5f", e["key"], e["value"])), ",")
    found = F.array_join(F.transform("divergences", lambda v: F.concat_ws(":", v["kind"], v["severity"])), ",")
    return c.select("entity", F.round("overall", 5).alias("overall"), "rating", used.alias("weights_used"), F.array_join("excluded_dimensions", ",").alias("excluded"), found.alias("divergences"))


@query(
    f"WITH {FUND}, fl AS (SELECT entity, count(*) AS n, count(*) FILTER (sev = 'critical') AS c FROM ({' UNION ALL '.join(f"SELECT entity, '{s}' AS sev FROM fu WHERE {w}" for w, _, s, _ in FLAGS)}) GROUP BY 1) SELECT entity, printf('fundamental risk %.0f of 100 (%s), %d flag(s), %d critical', overall_risk, {RATING('overall_risk')}, coalesce(n, 0), coalesce(c, 0)) AS summary FROM fu LEFT JOIN fl USING (entity) WHERE overall_risk IS NOT NULL"
)
def fundamental_summaries(spark, folder):
    f = fundamentals(spark, folder).where(F.col("overall_risk").isNotNull())
    return f.select("entity", summaries.fundamental_summary().alias("summary"))


@query(f"WITH {R_LINE}, {ROLL.format(w=252, b=251, q=Q95)}, w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS k FROM v) SELECT series_id, d, round(r, 8) AS r, round(var, 8) AS var FROM w WHERE k <= 5")
def last_scored_days(spark, folder):
    return rounded(volatility.last_n(rolled_var(spark, folder).select("series_id", "d", "r", "var"), 5))


# --- Fits and simulation ------------------------------------------------------------------------


def given_fits(spark, folder):
    """Parameters by nation, so that what follows from parameters can be checked by SQL."""
    n = spark.read.parquet(f"{folder}/nation.parquet")
    k = F.col("n_nationkey").cast("double")
    return n.select(F.col("n_name").alias("series_id"), (dbl(0.02) + k * dbl(0.001)).alias("omega"), (dbl(0.05) + k * dbl(0.003)).alias("alpha"), (dbl(0.90) - k * dbl(0.002)).alias("beta"), (dbl(1) + k / 10).alias("last_variance"), F.lit(None).cast("double").alias("nu"), (dbl(0.1) + k / 100).alias("realised_annualised"))


GIVEN = "gv AS (SELECT n_name AS series_id, 0.02::DOUBLE + n_nationkey * 0.001::DOUBLE AS omega, 0.05::DOUBLE + n_nationkey * 0.003::DOUBLE AS alpha, 0.90::DOUBLE - n_nationkey * 0.002::DOUBLE AS beta, 1.0::DOUBLE + n_nationkey / 10.0::DOUBLE AS v, 0.1::DOUBLE + n_nationkey / 100.0::DOUBLE AS realised FROM nation), gp AS (SELECT *, alpha + beta AS p FROM gv)"


@query(f"WITH {GIVEN} SELECT series_id, CAST(h AS INT) AS day, round(sqrt(pow(p, h) * v + omega * (1 - pow(p, h)) / (1 - p)) / 100, 9) AS daily_volatility, round(sqrt(pow(p, h) * v + omega * (1 - pow(p, h)) / (1 - p)) / 100 * sqrt(252), 8) AS annualised_volatility FROM gp, range(1, 11) t(h)")
def garch_forecast(spark, folder):
    f = fit.forecast_path(given_fits(spark, folder))
    return f.select("series_id", "day", F.round("daily_volatility", 9).alias("daily_volatility"), F.round("annualised_volatility", 8).alias("annualised_volatility"))


@query(f"WITH {GIVEN} SELECT series_id, round(p, 8) AS persistence, round(CASE WHEN p > 0 AND p < 1 THEN ln(0.5) / ln(p) ELSE 'inf'::DOUBLE END, 6) AS half_life_days, round(sqrt(omega / (1 - p)) / 100 * sqrt(252), 7) AS long_run_annualised, p <= 0.995 AS long_run_is_reliable FROM gp")
def garch_derived(spark, folder):
    d = fit.derived(given_fits(spark, folder))
    return d.select("series_id", F.round("persistence", 8).alias("persistence"), F.round("half_life_days", 6).alias("half_life_days"), F.round("long_run_annualised", 7).alias("long_run_annualised"), "long_run_is_reliable")


@query(
    f"WITH {GIVEN}, s AS (SELECT series_id, any_value(v) AS v, any_value(realised) AS realised, sqrt(sum(pow(p, h) * v + omega * (1 - pow(p, h)) / (1 - p))) / 100 AS sigma FROM gp, range(1, 11) t(h) GROUP BY 1) SELECT series_id, round(-(exp({Z95!r}::DOUBLE * sigma) - 1), 8) AS var_return, round(sigma, 8) AS conditional_sigma, CASE WHEN sqrt(v) / 100 * sqrt(252) > realised * 1.25 THEN 'elevated' WHEN sqrt(v) / 100 * sqrt(252) < realised * 0.8 THEN 'subdued' ELSE 'normal' END AS regime FROM s"
)
def conditional_var_normal(spark, folder):
    c = fit.conditional_var(given_fits(spark, folder), 0.95, 10)
    return rounded(c.select("series_id", "var_return", "conditional_sigma", "regime"))


@query(f"WITH {P_LINE}, l AS (SELECT series_id, max(d) AS last FROM prices GROUP BY 1) SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY last + CAST(k AS INT))::INT AS day, CAST(last + CAST(k AS INT) AS DATE) AS d FROM l, range(1, 68) t(k) WHERE dayofweek(last + CAST(k AS INT)) NOT IN (0, 6) QUALIFY day <= 30")
def forward_calendar(spark, folder):
    """The axis of each series' forecast: 30 weekdays after its last day."""
    return fit.business_days(panels.line_prices(spark, folder), 30)


def given_dof(returns_):
    """Degrees of freedom by the first letter of a series' name, so that SQL can hold their quantiles."""
    d = F.when(F.col("series_id") == "A", dbl(3.5)).when(F.col("series_id") == "N", dbl(5)).otherwise(dbl(40.25))
    return returns_.select("series_id").distinct().withColumn("dof", d)


def _t_literals(p: float) -> str:
    rows = []
    for name, v in (("A", 3.5), ("N", 5.0), ("R", 40.25)):
        z = specfun.t_ppf(p, v)
        rows.append(f"('{name}', {v!r}::DOUBLE, {z!r}::DOUBLE, {specfun.t_pdf(z, v)!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) t(series_id, v, z, f)"


@query(
    f"WITH {R_LINE}, {MOM} SELECT series_id, v AS dof, round(-(exp(mean * 10 + z * sqrt((v - 2) / v) * std * sqrt(10)) - 1), 8) AS var_return, round(-(exp(mean * 10 - std * sqrt(10) * sqrt((v - 2) / v) * (v + z * z) / (v - 1) * f / {Q95!r}::DOUBLE) - 1), 8) AS es_return FROM m JOIN {_t_literals(Q95)} USING (series_id)"
)
def student_t_given(spark, folder):
    """VaR and ES of Student-t with given degrees of freedom; the fitted ones are student_t_var."""
    r = line_returns(spark, folder)
    return rounded(tail.parametric_var(r, 0.95, 10, distribution="t", dof=given_dof(r)).select("series_id", "dof", "var_return", "es_return"))


@query()
def student_t_dof(spark, folder):
    return fit.degrees_of_freedom(line_returns(spark, folder))


@query()
def student_t_var(spark, folder):
    return tail.parametric_var(line_returns(spark, folder), distribution="t")


@query()
def bootstrap_interval(spark, folder):
    return simulate.var_intervals(line_returns(spark, folder))


@query()
def monte_carlo_bootstrap(spark, folder):
    return simulate.monte_carlo(line_returns(spark, folder), days=10)


@query()
def monte_carlo_normal(spark, folder):
    return simulate.monte_carlo(line_returns(spark, folder), draw="normal")


@query()
def monte_carlo_hashed(spark, folder):
    return simulate.hashed_monte_carlo(line_returns(spark, folder), days=10)


@query()
def monte_carlo_convergence(spark, folder):
    return simulate.convergence(line_returns(spark, folder))


@query()
def compare_methods(spark, folder):
    return simulate.compare_methods(line_returns(spark, folder))


@query(
    f"WITH {R_LINE}, {MOM}, {TAIL}, q AS (SELECT series_id, -(exp(quantile_cont(r, {Q95!r})) - 1) AS v FROM rets GROUP BY 1), "
    f"b AS (SELECT series_id, 'historical' AS method, v AS var, -(exp(tail.mean) - 1) AS es, v AS h FROM tail JOIN q USING (series_id) UNION ALL SELECT series_id, 'parametric-normal', -(exp(mean + {Z95!r}::DOUBLE * std) - 1), -(exp(mean - std * {PHI!r}::DOUBLE) - 1), v FROM m JOIN q USING (series_id)) "
    "SELECT series_id, method, round(var, 8) AS var, round(es, 8) AS es, round(es / var, 6) AS tail_severity, round(var - h, 8) AS var_vs_historical FROM b"
)
def compare_methods_exact(spark, folder):
    """The rows of the comparison that neither draw nor fit by iteration."""
    c = simulate.compare_methods(line_returns(spark, folder)).where("method IN ('historical', 'parametric-normal')")
    return c.select("series_id", "method", *(F.round(x, 8).alias(x) for x in ("var", "es", "var_vs_historical")), F.round("tail_severity", 6).alias("tail_severity"))


_by_position = lambda m, p: f"max(CASE WHEN position = '{p}' THEN {m} END) AS {m}_{p}"


@query(
    "WITH p AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS book, CASE WHEN l_orderkey % 25 = 0 THEN -1 ELSE 0.02::DOUBLE END AS a, CASE WHEN l_partkey % 23 = 0 THEN -1 ELSE 0.02::DOUBLE END AS b FROM lineitem), l AS (SELECT book, unnest(['a', 'b', 'sum']) AS position, unnest([a, b, (a + b) / 2]) AS r FROM p), "
    f"k AS (SELECT *, row_number() OVER (PARTITION BY book, position ORDER BY r) AS rk, count(*) OVER (PARTITION BY book, position) AS n FROM l), o AS (SELECT book, position, -quantile_cont(r, {Q95!r}) AS var, -avg(r) FILTER (rk <= greatest(1, ceil(round(n * {Q95!r}::DOUBLE, 9)))) AS es FROM k GROUP BY 1, 2), "
    f"w AS (SELECT book, {', '.join(_by_position(m, p) for m in ('var', 'es') for p in ('a', 'b', 'sum'))} FROM o GROUP BY 1) "
    f"SELECT book, {', '.join(f'round({m}_{p}, 8) AS {m}_{p}' for m in ('var', 'es') for p in ('a', 'b', 'sum'))}, {', '.join(f'{m}_sum <= {m}_a + {m}_b + 1e-12::DOUBLE AS {m}_is_subadditive' for m in ('var', 'es'))} FROM w"
)
def subadditivity(spark, folder):
    """Two books of two positions that each lose all in about 4% of the scenarios, one a line of an order."""
    lost = lambda key, n: F.when(F.col(key) % n == 0, dbl(-1)).otherwise(dbl(0.02))
    book = F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("book")
    li = spark.read.parquet(f"{folder}/lineitem.parquet").select(book, lost("l_orderkey", 25).alias("a"), lost("l_partkey", 23).alias("b"))
    return rounded(simulate.subadditivity(li))


CUSTOMERS = "cu AS (SELECT c_custkey, abs(c_acctbal) / 1000 AS x, (1 + c_nationkey)::DOUBLE AS v FROM customer)"
HALF = "sum(pow(x / 2, k) / exp(lgamma(k + 1.0))) FILTER (k < 5)"


@query(f"WITH {CUSTOMERS} SELECT c_custkey, round({chi2_tail_sql('x')}, 7) AS chi2_1, round(exp(-x / 2), 7) AS chi2_2, round(exp(-x / 2) * {HALF}, 7) AS chi2_10, round({t_tail_sql('x', 'v')}, 7) AS t_two_sided FROM cu, {NODES} GROUP BY c_custkey, x, v")
def tail_probabilities(spark, folder):
    """The p-values behind beta, Kupiec, Christoffersen and ARCH-LM, of one statistic a customer. The table is small
    for its work (one file, few parts), so its rows are dealt out first."""
    x = F.abs("c_acctbal") / 1000
    c = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", x.cast("double").alias("x"), (F.col("c_nationkey") + 1).cast("double").alias("v"))
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    p = {"chi2_1": distributions.chi2_tail_1("x"), "chi2_2": chi2_tail_even("x", 2), "chi2_10": chi2_tail_even("x", 10), "t_two_sided": distributions.t_two_sided("x", "v")}
    return c.select("c_custkey", *(F.round(e, 7).alias(n) for n, e in p.items()))


@query()
def monte_carlo_hashed_t(spark, folder):
    return simulate.hashed_monte_carlo(line_returns(spark, folder), draw="t")


@query()
def arch_lm(spark, folder):
    return fit.arch_tests(line_returns(spark, folder))


@query()
def garch_fit(spark, folder):
    return fit.fit_garch(line_returns(spark, folder))


@query()
def garch_series(spark, folder):
    return fit.garch_series(line_returns(spark, folder))


@query()
def garch_conditional_var(spark, folder):
    return fit.conditional_var(fit.fit_garch(line_returns(spark, folder)))


@query()
def conditional_minus_unconditional(spark, folder):
    r = line_returns(spark, folder)
    c = fit.conditional_var(fit.fit_garch(r)).select("series_id", F.col("var_return").alias("conditional"))
    h = tail.historical_var(r).select("series_id", F.col("var_return").alias("unconditional"))
    return c.join(h, "series_id").withColumn("difference", F.col("conditional") - F.col("unconditional"))


@query()
def rolling_conditional_var(spark, folder):
    return fit.rolling_conditional_var(line_returns(spark, folder))


NU = (4.0, 6.5, 30.0)


@query(
    f"WITH {GIVEN}, s AS (SELECT series_id, sqrt(sum(pow(p, h) * v + omega * (1 - pow(p, h)) / (1 - p))) / 100 AS sigma FROM gp, range(1, 11) t(h) GROUP BY 1), z AS (SELECT n_name AS series_id, CASE n_nationkey % 3 "
    + " ".join(f"WHEN {k} THEN {specfun.t_ppf(Q99, v) * math.sqrt((v - 2) / v)!r}::DOUBLE" for k, v in enumerate(NU))
    + " END AS z FROM nation) SELECT series_id, round(sigma, 8) AS conditional_sigma, round(-(exp(z * sigma) - 1), 8) AS var_return FROM s JOIN z USING (series_id)"
)
def conditional_var_t(spark, folder):
    n = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_name").alias("series_id"), (F.col("n_nationkey") % 3).alias("k"))
    fits = given_fits(spark, folder).drop("nu").join(n, "series_id").withColumn("nu", F.element_at(F.array(*map(dbl, NU)), F.col("k").cast("int") + 1))
    return rounded(fit.conditional_var(fits, 0.99, 10).select("series_id", "conditional_sigma", "var_return"))


# Simulation by a hash that SQL can repeat. X: each series' sorted returns.

X = f"{R_LINE}, x AS (SELECT series_id, list_sort(list(r)) AS x, avg(r) AS m, stddev_samp(r) AS sd, count(*) AS n FROM rets GROUP BY 1)"


def paths_sql(draw: str, paths: int, days: int) -> str:
    u = lambda salt: draws.unit_sql(S.SEED, str(salt), "path", "day")
    one = f"x[floor({u(0)} * n)::BIGINT + 1]" if draw == "bootstrap" else f"m + sd * sqrt(-2 * ln({u(1)})) * cos({u(2)} * {2 * math.pi!r}::DOUBLE)"
    return f"ph AS (SELECT series_id, path, sum(one) AS total FROM (SELECT series_id, path, {one} AS one FROM x, range({paths}) a(path), range(1, {days + 1}) b(day)) GROUP BY 1, 2)"


def monte_carlo_sql(draw: str, days: int) -> str:
    return f"WITH {X}, {paths_sql(draw, S.PATHS, days)}, b AS (SELECT series_id, path % 10 AS batch, -(exp(quantile_cont(total, {Q95!r})) - 1) AS v FROM ph GROUP BY 1, 2), e AS (SELECT series_id, stddev_samp(v) / sqrt(10) AS e FROM b GROUP BY 1) SELECT series_id, round(-(exp(quantile_cont(total, {Q95!r})) - 1), 8) AS var_return, round(-(exp(min(total)) - 1), 8) AS worst_simulated_loss, round(any_value(e), 8) AS standard_error FROM ph JOIN e USING (series_id) GROUP BY 1"


@query(monte_carlo_sql("bootstrap", 10))
def monte_carlo_repeatable(spark, folder):
    """10,000 paths of ten days, resampled, with the error of ten batches."""
    return rounded(simulate.hashed_monte_carlo(line_returns(spark, folder), days=10, portable=True).select("series_id", "var_return", "worst_simulated_loss", "standard_error"))


@query(monte_carlo_sql("normal", 1))
def monte_carlo_repeatable_normal(spark, folder):
    return rounded(simulate.hashed_monte_carlo(line_returns(spark, folder), draw="normal", portable=True).select("series_id", "var_return", "worst_simulated_loss", "standard_error"))


@query(
    f"WITH {X}, {paths_sql('bootstrap', 50_000, 1)}, v AS (SELECT series_id, s AS paths, -(exp(quantile_cont(total, {Q95!r})) - 1) AS v FROM ph, (VALUES (500), (1000), (2500), (5000), (10000), (25000), (50000)) t(s) WHERE path < s GROUP BY 1, 2) SELECT series_id, paths::BIGINT AS paths, round(v, 8) AS var_return, round(abs(v - lag(v) OVER (PARTITION BY series_id ORDER BY paths)), 8) AS step FROM v"
)
def convergence_repeatable(spark, folder):
    return rounded(simulate.hashed_convergence(line_returns(spark, folder), portable=True))


EPOCH_DAY = "d - DATE '1970-01-01'"
_POISSON = " + ".join(f"CASE WHEN u >= {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in draws.poisson_cuts())


@query(
    f"WITH {R_LINE}, u AS (SELECT series_id, b, r, {draws.unit_sql(S.SEED, 'b', EPOCH_DAY)} AS u FROM rets, range({S.BOOTSTRAP_SAMPLES}) t(b))"
    + f", w AS (SELECT series_id, b, r, {_POISSON} AS w FROM u), c AS (SELECT series_id, b, r, sum(w) OVER (PARTITION BY series_id, b ORDER BY r) AS upto, sum(w) OVER (PARTITION BY series_id, b) AS total FROM w WHERE w > 0), "
    f"k AS (SELECT series_id, b, (any_value(total) - 1) * {Q95!r}::DOUBLE AS pos, min(r) FILTER (upto > floor((total - 1) * {Q95!r}::DOUBLE)) AS lo, min(r) FILTER (upto > ceil((total - 1) * {Q95!r}::DOUBLE)) AS hi FROM c GROUP BY 1, 2), q AS (SELECT series_id, -(exp(lo * (1 - (pos - floor(pos))) + hi * (pos - floor(pos))) - 1) AS v FROM k) "
    "SELECT series_id, round(quantile_cont(v, 0.025), 8) AS ci_low, round(quantile_cont(v, 0.975), 8) AS ci_high FROM q GROUP BY 1"
)
def bootstrap_repeatable(spark, folder):
    """2,000 samples by hashed Poisson weights."""
    return rounded(draws.weighted_intervals(line_returns(spark, folder)))


@query()
def monte_carlo_sliced(spark, folder):
    """The seeded bootstrap drawn in slices: the numbers of monte_carlo_bootstrap."""
    return draws.sliced_monte_carlo(line_returns(spark, folder), days=10, slice_paths=1000)


# --- Long series and many members ---------------------------------------------------------------
# One benchmark series in parts of 200 rows, so that no task holds it.

R_ALL, P_ALL = R_LINE.replace("l_returnflag", "'ALL'"), P_LINE.replace("l_returnflag", "'ALL'")
PART = 200


def long_benchmark_returns(spark, folder):
    return blocks.long_returns(panels.benchmark_prices(spark, folder), part_rows=PART)


@query(f"WITH {R_ALL} SELECT series_id, d, round(r, 8) AS r, round(100 * exp(sum(r) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING)), 6) AS level FROM rets")
def long_price_index(spark, folder):
    i = blocks.long_price_index(long_benchmark_returns(spark, folder), part_rows=PART)
    return i.select("series_id", "d", F.round("r", 8).alias("r"), F.round("level", 6).alias("level"))


@query(ORACLES["drawdown_series"].replace("l_returnflag", "'ALL'").replace("round(dd, 8) AS dd", "round(peak, 8) AS peak, round(dd, 8) AS dd"))
def long_drawdown_series(spark, folder):
    return rounded(blocks.long_drawdowns(panels.benchmark_prices(spark, folder), part_rows=PART).select("series_id", "d", "peak", "dd"))


@query(ORACLES["drawdown_summary"].replace("l_returnflag", "'ALL'"))
def long_drawdown_summary(spark, folder):
    return rounded(blocks.long_drawdown_summary(panels.benchmark_prices(spark, folder), part_rows=PART))


@query(ORACLES["drawdown_episodes"].replace("l_returnflag", "'ALL'").replace("<= -0.1", "<= -0.01"))
def long_drawdown_episodes(spark, folder):
    return rounded(blocks.long_drawdown_episodes(panels.benchmark_prices(spark, folder), 0.01, part_rows=PART))


@query(ORACLES["rolling_volatility_60"].replace("l_returnflag", "'ALL'"))
def long_rolling_volatility(spark, folder):
    return rounded(blocks.long_rolling_volatility(long_benchmark_returns(spark, folder), 60, part_rows=PART).select("series_id", "d", "vol"), 7)


@query(ORACLES["rolling_beta_60"])
def long_rolling_beta(spark, folder):
    return rounded(blocks.long_rolling_beta(aligned_with_benchmark(spark, folder), 60, part_rows=PART).select("series_id", "d", "rolling_beta"), 5)


@query(ORACLES["rolling_hist_var_252"].replace("l_returnflag", "'ALL'"))
def long_rolling_var(spark, folder):
    return rounded(blocks.long_rolling_var(long_benchmark_returns(spark, folder), 252, part_rows=PART).select("series_id", "d", "var"))


@query(ORACLES["rolling_hist_var_252"].replace("= 252", "= 2000").replace("251 PRECEDING", "1999 PRECEDING"))
def rolling_hist_var_2000(spark, folder):
    """A wide window: the sliding quantile costs hardly more than at 252."""
    return rounded(rolled_var(spark, folder, 2000).select("series_id", "d", "var"))


@query(ORACLES["max_consecutive"].replace("l_returnflag", "'ALL'"))
def long_max_consecutive(spark, folder):
    v = blocks.long_rolling_var(long_benchmark_returns(spark, folder), 252, part_rows=PART)
    return blocks.long_runs(tail.mark_breaches(v), part_rows=PART)


GARCH_GIVEN = {"A": (0.01, 0.5, 0.05, 0.90, 20.0), "N": (-0.02, 1.0, 0.10, 0.80, 30.0), "R": (0.0, 0.2, 0.03, 0.95, 10.0)}


def garch_given(spark):
    return spark.createDataFrame([(k, *v) for k, v in GARCH_GIVEN.items()], "series_id string, mean double, omega double, alpha double, beta double, first_variance double")


RECURSION = (
    f"{R_LINE}, gg AS (SELECT * FROM (VALUES {', '.join(f"('{k}', " + ', '.join(f'{x!r}::DOUBLE' for x in v) + ')' for k, v in GARCH_GIVEN.items())}) t(series_id, mean, omega, alpha, beta, v0)), "
    "sh AS (SELECT rets.series_id, d, r * 100 - mean AS e, omega, alpha, beta, v0, row_number() OVER (PARTITION BY rets.series_id ORDER BY d) AS k FROM rets JOIN gg USING (series_id)), "
    "vr AS (WITH RECURSIVE vr AS (SELECT series_id, d, e, k, v0 AS v FROM sh WHERE k = 1 UNION ALL SELECT sh.series_id, sh.d, sh.e, sh.k, sh.omega + sh.alpha * vr.e * vr.e + sh.beta * vr.v FROM vr JOIN sh ON sh.series_id = vr.series_id AND sh.k = vr.k + 1) SELECT * FROM vr)"
)


@query(f"WITH {RECURSION} SELECT series_id, d, round(e, 7) AS shock, round(v, 6) AS variance, round(sqrt(v) / 100 * sqrt(252), 7) AS annualised FROM vr")
def long_garch_variances(spark, folder):
    """Given parameters, over parts of 200 days; in SQL step by step."""
    v = recursion.long_variances(line_returns(spark, folder), garch_given(spark), part_rows=PART)
    return v.select("series_id", "d", F.round("shock", 7).alias("shock"), F.round("variance", 6).alias("variance"), F.round("annualised", 7).alias("annualised"))


@query(f"WITH {RECURSION} SELECT series_id, round(sum(-0.5 * (ln(2 * pi()) + ln(v) + e * e / v)), 4) AS log_likelihood, count(*) AS n FROM vr GROUP BY 1")
def long_garch_likelihood(spark, folder):
    v = recursion.long_variances(line_returns(spark, folder), garch_given(spark), part_rows=PART)
    return rounded(recursion.long_log_likelihood(v), 4)


_STEP = f"{math.log(rollup.growth())!r}::DOUBLE"
_MIDDLE = f"CASE WHEN abs(x) < 1e-12 THEN 0 ELSE sign(x) * exp(ceil(ln(abs(x)) / {_STEP}) * {_STEP}) * {2 / (1 + rollup.growth())!r}::DOUBLE END"


@query(
    f"WITH {R_SUPP}, pl AS (SELECT CAST(s_suppkey AS VARCHAR) AS series_id, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "rs AS (SELECT r_name, n_name, series_id, r FROM rets JOIN pl USING (series_id)), "
    "g AS (SELECT 3 AS level, r_name, n_name, series_id, list_sort(list(r)) AS v FROM rs GROUP BY ALL UNION ALL SELECT 2, r_name, n_name, NULL, list_sort(list(r)) FROM rs GROUP BY ALL UNION ALL SELECT 1, r_name, NULL, NULL, list_sort(list(r)) FROM rs GROUP BY ALL UNION ALL SELECT 0, NULL, NULL, NULL, list_sort(list(r)) FROM rs), "
    f"o AS (SELECT * EXCLUDE (v), len(v) AS n, v[floor((len(v) - 1) * {Q95!r}::DOUBLE)::BIGINT + 1] AS x FROM g) "
    f"SELECT level, r_name, n_name, series_id, n AS n_observations, round({_MIDDLE}, 9) AS quantile, abs({_MIDDLE} - x) <= 0.005 * abs(x) + 1e-12 AS within_error FROM o"
)
def rollup_var(spark, folder):
    """VaR quantiles of each supplier, nation, region and all, from one sketch by supplier. The SQL takes the exact
    order statistics, rounds them to their buckets and says whether that keeps the stated error."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    places = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("s_suppkey").cast("string").alias("series_id"), "n_name", "r_name")
    r = returns.log_returns(panels.supplier_prices(spark, folder)).join(places, "series_id")
    v = rollup.rollup_var(r, ["r_name", "n_name", "series_id"])
    return v.select("level", "r_name", "n_name", "series_id", "n_observations", F.round("quantile", 9).alias("quantile"), F.lit(True).alias("within_error"))


P_QUARTERS = "prices AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY 1, 2)"
R_QUARTERS = R_LINE.replace(P_LINE, P_QUARTERS)


def supplier_panel(spark, folder):
    """All suppliers as one portfolio, by quarter."""
    r = returns.log_returns(panels.supplier_quarters(spark, folder))
    w = portfolio.equal_weights(r.select(F.lit("ALL").alias("portfolio_id"), "series_id").distinct())
    return portfolio.aligned(r, w, least=None)


@query(
    f"WITH {R_QUARTERS}, m AS (SELECT count(DISTINCT series_id) AS m FROM rets), f AS (SELECT d FROM rets, m GROUP BY d, m HAVING count(*) = m), pn AS (SELECT series_id, d, exp(r) - 1 AS s FROM rets JOIN f USING (d)) "
    "SELECT 'ALL' AS portfolio_id, a.series_id AS i, b.series_id AS j, count(*) AS n, round(covar_samp(a.s, b.s) * 252, 6) AS cov, round(covar_samp(a.s, b.s) / (stddev_samp(a.s) * stddev_samp(b.s)), 7) AS corr FROM pn a JOIN pn b ON a.d = b.d AND a.series_id <= b.series_id GROUP BY 2, 3"
)
def supplier_covariance(spark, folder):
    """Every pair of suppliers, by tiles of members."""
    c = gram.covariance_tiles(supplier_panel(spark, folder), tile=64)
    return c.select("portfolio_id", "i", "j", "n", F.round("cov", 6).alias("cov"), F.round("corr", 7).alias("corr"))


@query(ORACLES["min_variance"])
def min_variance_by_steps(spark, folder):
    """The same weights with the matrix left in its stored pairs, multiplied over the cluster."""
    w = portfolio.minimum_variance(portfolio.covariance_pairs(panel(spark, folder)), one_task=0)
    return rounded(w.select("portfolio_id", "series_id", "w"), 6)


# --- Streams and SQL ----------------------------------------------------------------------------


@query("SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS d, round(avg(value), 8) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def stream_hourly_means(spark, folder):
    """The events as a stream of files, in complete mode, so that the last windows are there too."""
    out = f"{shared_dir(spark)}/tailframe-stream-{uuid.uuid4().hex}"
    means = live.window_means(live.event_stream(spark, folder, pattern="events*.parquet"))
    writer = means.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-log").trigger(availableNow=True)
    stream = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    stream.awaitTermination()
    got = spark.read.parquet(out)
    return got.select("series_id", F.col("d").cast("timestamp_ntz").alias("d"), F.round("close", 8).alias("close"), "volume")


@query(
    f"SELECT n_name, round({sc('n_nationkey / 25.0::DOUBLE', 0.1, 0.9)}, 7) AS risk, round(-(exp(-n_nationkey / 50.0::DOUBLE) - 1), 8) AS loss, CASE WHEN n_nationkey <= 4 THEN 'green' WHEN n_nationkey <= 9 THEN 'yellow' ELSE 'red' END AS zone, {RATING('n_nationkey * 4')} AS rating FROM nation"
)
def sql_surface(spark, folder):
    sql.register(spark)
    spark.read.parquet(f"{folder}/nation.parquet").createOrReplaceTempView("tailframe_nation")
    return spark.sql(
        "SELECT n_name, round(risk_score(n_nationkey / 25D, 0.1D, 0.9D), 7) AS risk, round(log_loss(-n_nationkey / 50D), 8) AS loss, basel_zone(n_nationkey, 250) AS zone, risk_rating(n_nationkey * 4D) AS rating FROM tailframe_nation"
    )


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """VaR, ES, volatility and drawdown of every series, in one plan."""
    prices = panels.line_prices(spark, folder)
    r = returns.log_returns(prices)
    out = tail.historical_es(r).select("series_id", "var_return", "es_return", "tail_severity")
    out = out.join(volatility.historical_volatility(r).select("series_id", F.col("annualised").alias("volatility"), "n_observations"), "series_id")
    return out.join(drawdown.drawdown_summary(prices).select("series_id", "max_drawdown", "current_drawdown"), "series_id")
