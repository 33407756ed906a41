import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import draws, order, simulate

from .helpers import fat_returns, normal_returns, one, table


@pytest.fixture(scope="module")
def logs(spark):
    return table(spark, {"A": fat_returns(700), "B": normal_returns(333), "C": [0.01], "D": [0.01] * 50}).cache()


def test_units_are_even(spark):
    n = 200_000
    u = spark.range(n).select(draws.unit(7, F.lit(3), F.col("id")).alias("u"), draws.unit(7, F.lit(3), F.col("id") + 1).alias("v"))
    r = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.var_pop("u"), F.corr("u", "v"), F.count_distinct("u")).first()
    assert 0 < r[0] < 1e-3
    assert 1 - 1e-3 < r[1] < 1
    assert r[2] == pytest.approx(0.5, abs=0.003)
    assert r[3] == pytest.approx(1 / 12, abs=0.001)
    assert abs(r[4]) < 0.01
    assert r[5] > n * 0.999
    bins = u.groupBy(F.floor(F.col("u") * 100)).count().toPandas()["count"]
    assert ((bins - n / 100) ** 2 / (n / 100)).sum() < 160  # chi-square with 99 degrees of freedom


def test_poisson_weights(spark):
    w = spark.range(100_000).select(draws.poisson(draws.unit(1, F.col("id"))).alias("w"))
    shares = {r.w: r["count"] / 100_000 for r in w.groupBy("w").count().collect()}
    assert shares[0] == pytest.approx(np.exp(-1), abs=0.005)
    assert shares[1] == pytest.approx(np.exp(-1), abs=0.005)
    assert w.agg(F.avg("w")).first()[0] == pytest.approx(1, abs=0.01)


def test_weighted_intervals_are_close_to_resampling(logs):
    exact = {r.series_id: r for r in simulate.var_intervals(logs).collect()}
    got = {r.series_id: r for r in draws.weighted_intervals(logs).collect()}
    assert set(got) == {"A", "B", "D"}
    for k in "AB":
        width = exact[k].ci_high - exact[k].ci_low
        assert got[k].ci_low == pytest.approx(exact[k].ci_low, abs=0.15 * width)
        assert got[k].ci_high == pytest.approx(exact[k].ci_high, abs=0.15 * width)
    assert got["D"].ci_low == got["D"].ci_high == pytest.approx(1 - np.exp(0.01))


def test_longer_horizons_scale(logs):
    a, b = (one(draws.weighted_intervals(logs, days=days, samples=40), series_id="A") for days in (1, 10))
    assert b.ci_low == pytest.approx(1 - np.exp(np.log1p(-a.ci_low) * np.sqrt(10)))


@pytest.mark.parametrize("deviations", [8.0, 0.0])
def test_weighted_intervals_by_brute_force(logs, monkeypatch, deviations):
    """Also if the first range is too narrow for some samples: it is widened until it holds all."""
    monkeypatch.setattr(draws, "DEVIATIONS", deviations or 0.25)
    samples, level = 60, 1 - 0.95
    rows = logs.where("series_id = 'A'").select("d", "r").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    rows = rows.withColumn("w", draws.poisson(draws.unit(5, F.col("sample"), F.unix_date("d")))).toPandas()
    q = [np.quantile(np.repeat(g["r"], g["w"]), level) for _, g in rows.groupby("sample")]
    want = np.percentile(-(np.exp(q) - 1), [2.5, 97.5])
    got = one(draws.weighted_intervals(logs, samples=samples, seed=5), series_id="A")
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(want), rel=1e-9)


@pytest.mark.parametrize("n", [2, 7, 1000, 3_000_000_000])
def test_slices_of_the_stream(n):
    """Draws jump ahead; a size near 2^32 rejects a third of the words."""
    want = np.random.default_rng(11).integers(0, n, size=5000)
    reach = 20_000
    lost = np.flatnonzero(draws._rejected(draws._words(11, 0, reach), n))
    assert len(lost) > 1000 or n < 10_000
    got = [draws.draws(11, n, k, min(777, 5000 - k), lost) for k in range(0, 5000, 777)]
    assert np.concatenate(got).tolist() == want.tolist()


@pytest.mark.parametrize(("days", "slice_paths"), [(1, 64), (10, 100), (10, 5000)])
def test_sliced_paths_are_the_seeded_ones(logs, days, slice_paths):
    got = draws.sliced_paths(logs, 1000, days, 42, slice_paths=slice_paths).toPandas().sort_values("path")
    assert got["series_id"].nunique() == 3
    for name, x in (("A", fat_returns(700)), ("B", normal_returns(333))):
        want = simulate.draw_paths(np.asarray(x), 1000, days, "bootstrap", np.random.default_rng(42))
        assert got[got["series_id"] == name]["total"].tolist() == want.tolist()


def test_sliced_monte_carlo_equals_the_one_task_result(logs):
    want = one(simulate.monte_carlo(logs, 0.95, 10, paths=2000), series_id="A")
    got = one(draws.sliced_monte_carlo(logs, 0.95, 10, 2000, slice_paths=300), series_id="A")
    assert got.var_return == pytest.approx(want.var_return, rel=1e-12)
    assert got.es_return == pytest.approx(want.es_return, rel=1e-10)
    assert got.standard_error == pytest.approx(want.standard_error, rel=1e-9)
    assert (got.simulated_tail, got.paths) == (want.simulated_tail, 2000)
    with pytest.raises(ValueError, match="100 paths"):
        draws.sliced_monte_carlo(logs, paths=50)


def test_convergence_is_nested(logs):
    c = {r.paths: r for r in simulate.hashed_convergence(logs, (500, 1000, 2000), portable=True).where("series_id = 'A'").collect()}
    assert c[500].step is None
    assert c[2000].step == pytest.approx(abs(c[2000].var_return - c[1000].var_return))
    whole = one(simulate.hashed_monte_carlo(logs, paths=1000, portable=True), series_id="A")
    assert c[1000].var_return == pytest.approx(whole.var_return)
    assert order.quantile(simulate.hashed_paths(logs, 1000, portable=True).withColumnRenamed("total", "r"), 0.05).count() == 3
