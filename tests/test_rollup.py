import numpy as np
import pytest
from pyspark.sql import functions as F

from tailframe.operators import rollup


def frame(spark, rows):
    return spark.createDataFrame([(a, b, float(x)) for a, b, x in rows], "a string, b string, r double").repartition(5)


@pytest.mark.parametrize(("confidence", "error"), [(0.95, 0.005), (0.99, 0.05), (0.6, 0.001)])
def test_quantiles_of_every_level_are_within_the_error(spark, confidence, error):
    rng = np.random.default_rng(4)
    rows = [(f"a{k % 3}", f"b{k % 7}", x) for k, x in enumerate(np.concatenate([rng.standard_t(3, 2000) / 50, np.zeros(300), [1e-14, -1e-9, 5.0]]))]
    got = {(r.level, r.a, r.b): r for r in rollup.rollup_var(frame(spark, rows), ["a", "b"], confidence, error).collect()}
    assert len(got) == 21 + 3 + 1
    for (level, a, b), r in got.items():
        values = np.sort([x for p, q, x in rows if (level < 1 or p == a) and (level < 2 or q == b)])
        exact = values[int(np.floor((len(values) - 1) * (1 - confidence)))]
        assert r.n_observations == len(values)
        assert abs(r.quantile - exact) <= error * abs(exact) * (1 + 1e-9) + 1e-12
        assert r.var_return == pytest.approx(1 - np.exp(r.quantile))


def test_buckets_rise_with_values(spark):
    x = sorted([-3.0, -1.0, -0.5, -1e-13, 0.0, 1e-13, 1e-8, 0.5, 0.50001, 9.0])
    b = [r.b for r in frame(spark, [("a", "b", v) for v in x]).orderBy("r").select(rollup.bucket(F.col("r")).alias("b")).collect()]
    assert b == sorted(b)
    assert b[3:6] == [0, 0, 0]


def test_sketches_merge(spark):
    """Counts of parts add up to the counts of the whole."""
    rng = np.random.default_rng(1)
    whole = frame(spark, [("a", f"b{k % 4}", x) for k, x in enumerate(rng.normal(size=500))])
    merged = rollup.sketches(whole, ["a", "b"]).groupBy("a", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, rollup.sketches(whole, ["a"]).collect()))


def test_missing_values_and_no_rows(spark):
    df = frame(spark, [("a", "b", float("nan")), ("a", "b", -0.1)])
    assert {r.n_observations for r in rollup.rollup_var(df, ["a", "b"]).collect()} == {1}
    assert rollup.rollup_var(df.limit(0), ["a", "b"]).collect() == []


def test_the_finest_level_is_not_rolled_up_again(spark):
    """Its rows aren't copied for each level above, and lie in as many parts as are asked for."""
    rows = [(f"a{k % 2}", f"b{k}", x) for k in range(20) for x in (-0.2, 0.1, 0.3)]
    out = rollup.rollup_var(frame(spark, rows), ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan
    assert f"{spark.conf.get('spark.sql.shuffle.partitions')}), REPARTITION_BY_NUM" in plan
    assert sorted(r.level for r in out.collect()) == [0, 1, 1] + [2] * 20
