"""Connected components of a distributed edge list.

Every step works on edges only. Hot nodes are safe: minima are taken by aggregates with
map-side combining, never by gathering the neighbours of a node, and the edges of a hot node are
dealt into parts before they meet its minimum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, ship, stored

#: Edges that one local union-find holds.
LOCAL_EDGES = 200_000


def forest(pairs) -> list[tuple]:
    """(node, root) for the nodes of the pairs that aren't their component's smallest."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return [(x, find(x)) for x in list(parent)]


def merge_labels(root: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """root: the label of each index, its group's least index. The labels once the groups that the
    pairs (arrays of 2 x n indexes) join are one."""
    if not pairs:
        return root
    a, b = np.concatenate(pairs, axis=1)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            return root
        root = new


def _contract(batches):
    names, held = ["a", "b"], []

    def out():
        found = forest(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=names)

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= LOCAL_EDGES:
            yield out()
    if held:
        yield out()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (a long, b long), undirected, repeats and loops allowed. Returns (node, root)
    for each node that has an edge to another and isn't its component's smallest; all other
    nodes are their own root. Large-star and small-star rounds until nothing changes."""
    ship(edges.sparkSession)
    now = stored(edges.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        # Large star: each neighbour above a node is linked to the smallest one around it.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.where("b > a"), least.select("a", "m"), "a", least.select("a", "n"), 2 * mark[0], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours and itself are linked to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least.select("a", "m"), "a", least.select("a", "n"), mark[0], "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
