"""The column expressions against printed tables and against the numpy functions."""

import math

import pytest
from pyspark.sql import functions as F

from tailframe.functions import distributions as D
from tailframe.functions import specfun
from tailframe.functions.columns import chi2_tail_even, dbl
from tailframe.operators import backtest, beta, tail

from .helpers import normal_returns, table

# Two-sided Student-t and upper chi-square points as printed in statistical tables.
T_POINTS = ((12.7062, 1, 0.05), (2.5706, 5, 0.05), (4.0321, 5, 0.01), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (2.0423, 30, 0.05), (2.7500, 30, 0.01), (1.9799, 120, 0.05))
CHI2_POINTS = ((2.7055, 1, 0.10), (3.8415, 1, 0.05), (6.6349, 1, 0.01), (4.6052, 2, 0.10), (5.9915, 2, 0.05), (9.2103, 2, 0.01), (15.9872, 10, 0.10), (18.3070, 10, 0.05), (23.2093, 10, 0.01))


def values(spark, rows, names, **columns):
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in r) for r in rows], ", ".join(f"{n} double" for n in names))
    return df.select(*names, *(c.alias(k) for k, c in columns.items())).collect()


def test_printed_tables(spark):
    for r in values(spark, T_POINTS, ("x", "v", "want"), p=D.t_two_sided("x", "v")):
        assert r.p == pytest.approx(r.want, abs=5e-5)
    tails = F.when(F.col("v") == 1, D.chi2_tail_1("x")).when(F.col("v") == 2, chi2_tail_even("x", 2)).otherwise(chi2_tail_even("x", 10))
    for r in values(spark, CHI2_POINTS, ("x", "v", "want"), p=tails):
        assert r.p == pytest.approx(r.want, abs=5e-5)


def test_erfc_and_gamma(spark):
    rows = [(z,) for z in (0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.999999, 2.0, 2.5, 4.0, 6.0, 20.0)]
    for r in values(spark, rows, ("z",), e=D.erfc("z"), g=D.ln_gamma(F.col("z") + 0.25)):
        assert r.e == pytest.approx(math.erfc(r.z), rel=1e-9, abs=1e-15)
        assert r.g == pytest.approx(math.lgamma(r.z + 0.25), rel=1e-12, abs=1e-12)


def test_student_t(spark):
    rows = [(t, v) for t in (0.0, 1e-6, -0.3, 1.0, 2.5, -9.0, 60.0) for v in (1.0, 2.05, 3.5, 10.0, 77.3, 2498.0, 100_000.0)]
    for r in values(spark, rows, ("t", "v"), p=D.t_two_sided("t", "v"), f=D.t_density("t", "v")):
        assert r.p == pytest.approx(specfun.t_two_sided(r.t, r.v), rel=1e-8, abs=1e-14)
        assert r.f == pytest.approx(specfun.t_pdf(r.t, r.v), rel=1e-9, abs=1e-300)


def test_quantiles(spark):
    rows = [(p, v) for p in (1e-4, 0.01, 0.05, 0.3, 0.5, 0.9, 0.995) for v in (2.05, 2.5, 4.0, 33.3, 250.0)]
    for r in values(spark, rows, ("p", "v"), q=D.t_quantile("p", "v")):
        assert r.q == pytest.approx(specfun.t_ppf(r.p, r.v), rel=1e-8, abs=1e-9)


def test_missing(spark):
    (r,) = values(spark, [(None, None)], ("x", "v"), a=D.chi2_tail_1("x"), b=D.t_two_sided("x", dbl(3)), c=D.t_two_sided(dbl(1), "v"), d=D.t_quantile(dbl(0.05), "v"), e=D.t_two_sided(dbl(1), dbl(0)))
    assert r[2:] == (None,) * 5
    (r,) = values(spark, [(-1e-12, 0)], ("x", "v"), a=D.chi2_tail_1("x"))
    assert r.a == 1.0


def test_plans_without_python(spark):
    r = table(spark, {"a": normal_returns(300)})
    market = r.withColumn("r", F.col("r") * 0.5)
    scored = tail.mark_breaches(r.withColumn("var", dbl(0.02)))
    plans = [beta.regression(beta.align(r, market)), backtest.backtest(scored), tail.parametric_var(r, distribution="t", dof=r.select("series_id").distinct().withColumn("dof", dbl(5)))]
    for df in plans:
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_small_file_are_dealt_out(spark, tmp_path):
    """Hundreds of steps a row: the rows of one file must not be one task's."""
    from tailframe import queries

    spark.range(64).selectExpr("id AS c_custkey", "100D * id - 999D AS c_acctbal", "CAST(id % 25 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.tail_probabilities(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.c_custkey: r for r in out.collect()}
    assert len(got) == 64
    for k, r in got.items():
        x, v = abs(100.0 * k - 999.0) / 1000, k % 25 + 1.0
        assert (r.chi2_1, r.t_two_sided) == pytest.approx((specfun.chi2_tail_1(x), specfun.t_two_sided(x, v)), abs=1e-7)
