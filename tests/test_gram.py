import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import gram, portfolio

from .helpers import business_days


def panel(spark, values, portfolio_id="P", names=None):
    """values: members x days of simple returns."""
    names = names or [f"m{k:03d}" for k in range(len(values))]
    rows = [(portfolio_id, n, d, float(x), 1.0 / len(values)) for n, v in zip(names, values, strict=True) for d, x in zip(business_days(len(v)), v, strict=True)]
    return spark.createDataFrame(rows, "portfolio_id string, series_id string, d date, s double, w double").repartition(5)


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 0.01, (23, 300)) + rng.normal(0, 0.01, 300)
    b = rng.normal(0, 0.02, (3, 90))
    b[2] = 0.01  # doesn't vary
    return panel(spark, a).unionByName(panel(spark, b, "Q")).cache()


@pytest.mark.parametrize(("tile", "chunk"), [(4, 50), (23, 1000), (7, 100)])
def test_tiles_give_the_same_pairs(two, tile, chunk):
    key = lambda r: (r.portfolio_id, r.i, r.j)
    want = {key(r): r for r in portfolio.covariance_pairs(two).collect()}
    got = {key(r): r for r in gram.covariance_tiles(two, tile=tile, chunk_days=chunk).collect()}
    assert got.keys() == want.keys()
    assert len(got) == 23 * 24 // 2 + 6
    for k, g in got.items():
        w = want[k]
        assert (g.n, g.wi, g.wj) == (w.n, w.wi, w.wj)
        assert g.cov == pytest.approx(w.cov, rel=1e-9, abs=1e-15)
        assert g.corr == (pytest.approx(w.corr, rel=1e-9, abs=1e-12) if w.corr is not None and "m002" not in k[1:] else g.corr)


def test_shuffled_rows_grow_with_tiles(two):
    """What meets are blocks, each once for each tile: not the pairs of a day's members."""
    plan = gram.covariance_tiles(two, tile=4)._jdf.queryExecution().executedPlan().toString()
    assert "block#" in plan
    assert "collect_list" not in plan


@pytest.mark.parametrize(("band", "fewest"), [(12, 1), (8, 2), (100, 1)])
def test_pairs_are_not_shuffled(two, monkeypatch, band, fewest):
    """Bands of several tiles give the same pairs, and a pair is made whole in the task that hands it out."""
    monkeypatch.setattr(gram, "BAND", band)
    monkeypatch.setattr(gram, "FEWEST_BANDS", fewest)
    tiled = gram.covariance_tiles(two, tile=4, chunk_days=50)
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "hashpartitioning(portfolio_id" in plan and ", i#" not in plan.split("Exchange")[1].split("\n")[0]
    want = {(r.portfolio_id, r.i, r.j): r.cov for r in portfolio.covariance_pairs(two).collect()}
    got = [((r.portfolio_id, r.i, r.j), r.cov) for r in tiled.collect()]
    assert len(got) == len(want)
    assert dict(got) == pytest.approx(want, rel=1e-9, abs=1e-15)


def shuffled_rows(df):
    """Rows written by the exchanges of a plan that has run."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows


def test_copies_of_a_panel_do_not_grow_with_members(spark, monkeypatch):
    """Blocks meet a bounded number of bands, as long as a band's values fit a task, and pairs stay the same."""
    monkeypatch.setattr(gram, "BAND", 2)
    rng = np.random.default_rng(4)
    rows = {}
    for members in (60, 120):
        p = panel(spark, rng.normal(0, 0.01, (members, 10)))
        tiled = gram.covariance_tiles(p, tile=1)
        got = [((r.i, r.j), r.cov) for r in tiled.collect()]
        assert len(got) == members * (members + 1) // 2
        assert dict(got) == pytest.approx({(r.i, r.j): r.cov for r in portfolio.covariance_pairs(p).collect()}, rel=1e-9, abs=1e-15)
        rows[members] = shuffled_rows(tiled)
    assert 0 < rows[120] <= 2.2 * rows[60]
    short = gram.covariance_tiles(p, tile=1, chunk_days=20)  # a band holds the values of 2 members over 20 days: 4 over 10
    assert len(short.collect()) == len(got)
    assert shuffled_rows(short) == 120 * 30


def test_analysis_uses_tiles_for_many_members(spark, monkeypatch):
    rng = np.random.default_rng(9)
    p = panel(spark, rng.normal(0, 0.01, (6, 80)))
    plain = {(r.i, r.j): r.cov for r in portfolio.all_pairs(p).collect()}
    monkeypatch.setattr(gram, "FEW_MEMBERS", 2)
    tiled = {(r.i, r.j): r.cov for r in portfolio.all_pairs(p).collect()}
    assert tiled == pytest.approx(plain, rel=1e-9)


def pairs_of(spark, matrices):
    rows = [(p, f"m{i:03d}", f"m{j:03d}", float(m[i, j])) for p, m in matrices.items() for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, "portfolio_id string, i string, j string, cov double")


def pinv_weights(m):
    w = np.linalg.pinv(m) @ np.ones(len(m))
    return w / w.sum()


@pytest.mark.parametrize("one_task", [2000, 0])
def test_minimum_variance(spark, one_task):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 12)) @ np.diag(np.linspace(0.5, 2, 12))
    full, singular = np.cov(x.T), np.cov(rng.normal(size=(4, 6)).T)
    zero, hedge, missing = np.zeros((2, 2)), np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[1.0, np.nan], [np.nan, 1.0]])
    matrices = {"full": full, "singular": singular, "zero": zero, "hedge": hedge, "missing": missing}
    got = {}
    for r in gram.minimum_variance(pairs_of(spark, matrices), one_task).collect():
        got.setdefault(r.portfolio_id, {})[r.series_id] = (r.w, r.reason)
    for name in ("full", "singular", "hedge"):
        w = [got[name][k][0] for k in sorted(got[name])]
        assert w == pytest.approx(pinv_weights(matrices[name]).tolist(), rel=1e-6, abs=1e-8)
        assert all(x[1] is None for x in got[name].values())
    assert set(got["zero"].values()) == {(None, "the covariance matrix is degenerate")}
    assert set(got["missing"].values()) == {(None, "missing covariances")}


def test_five_hundred_members(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 500)) * rng.uniform(0.5, 2, 500) + rng.normal(size=(1500, 1))
    m = np.cov(x.T)
    got = {r.series_id: r.w for r in gram.minimum_variance(pairs_of(spark, {"P": m})).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx(pinv_weights(m).tolist(), rel=1e-5, abs=1e-8)


def test_large_matrices_are_iterated_on_over_the_cluster(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 60)) + rng.normal(size=(400, 1))
    m = np.cov(x.T)
    got = {r.series_id: r.w for r in gram.minimum_variance(pairs_of(spark, {"P": m}), one_task=50).collect()}
    assert [got[k] for k in sorted(got)] == pytest.approx(pinv_weights(m).tolist(), rel=1e-5, abs=1e-8)


def test_weights_that_vanish():
    assert gram._weights(np.array([1.0, -1.0]), True) == (None, "the covariance matrix is degenerate")
    assert gram._weights(np.array([1.0, 1.0]), False) == (None, "no convergence")
    w, why = gram._weights(np.array([1.0, 3.0]), True)
    assert (w.tolist(), why) == ([0.25, 0.75], None)


def test_no_portfolios(spark, two):
    assert gram.covariance_tiles(two.limit(0)).collect() == []
    assert gram.minimum_variance(pairs_of(spark, {"P": np.eye(2)}).where(F.lit(False))).collect() == []
