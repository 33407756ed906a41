"""One key holds half of the rows, with thresholds low enough that it counts as hot."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tailframe.llm import common, graph, sharding, simhash


@pytest.fixture(autouse=True)
def _low_thresholds(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "MOST_HOT", 50)
    monkeypatch.setattr(graph, "LOCAL_EDGES", 7)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, how):
    left = spark.range(400).select((F.col("id") % 200 * (F.col("id") % 2)).alias("key"), F.col("id").alias("x"))
    right = spark.range(0, 150).select(F.col("id").alias("key"), (F.col("id") * 10).alias("y"))
    sizes = left.groupBy("key").agg(F.count("*").alias("n"))
    got = common.hot_join(left, right, "key", sizes, 400, "x", how)
    want = left.join(right, "key", how)
    assert sorted(map(str, got.select("key", "x", "y").collect())) == sorted(map(str, want.select("key", "x", "y").collect()))


def test_components_of_stars_and_chains(spark):
    edges = [(0, k) for k in range(1, 300)] + [(1000 + k, 2000) for k in range(300)] + [(3000 + k, 3001 + k) for k in range(100)] + [(2000, 3050), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {k: 0 for k in range(1, 300)} | {k: 1000 for k in [*range(1001, 1300), 2000, *range(3000, 3101)]}


def copies():
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, text) for k in range(100)] + [(k, None) for k in range(100, 140)]
    return rows + [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(140, 200)]


def test_groups_of_half_of_all_rows(spark):
    docs = spark.createDataFrame(copies(), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: 0 if k < 100 else 100 if k < 140 else k for k in range(200)}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 100, *range(140, 200)]


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 30)
    docs = spark.createDataFrame([(1, "same")] * 150 + [(None, None)] * 20 + [(k, "t") for k in range(150)], "doc_id long, text string").repartition(5)
    got = sharding.shard(docs, 8).collect()
    assert Counter((r.doc_id, r.size) for r in got)[1, 5] == 150
    assert sorted(r.row_number for r in got) == list(range(320))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(40))
