import math
import random

import numpy as np

from tailframe.llm import vecdedup
from tailframe.llm.graph import forest


def table(seed=3, labels=3, n=260, dim=12):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        v = [r.gauss(0, 1) for _ in range(dim)]
        if k % 4 == 1:
            v = [x + r.gauss(0, 0.06) for x in rows[-1][1]]
        if k % 10 == 3:
            v = rows[-1][1]
        rows.append((k, v, r.randrange(labels) if k % 10 not in (1, 3) and k % 4 != 1 else rows[-1][2]))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, v, 0) for k, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], None), (None, rows[5][1], rows[5][2]), rows[7], rows[7]]
    return rows


def brute(rows, threshold=0.98):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    ok = [good(v, label) for _, v, label in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= threshold]
    root = dict(forest(links))
    out = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root.get(m, m) == root.get(k, k) and rows[m][0] is not None]
        least = min(ids, default=None)
        out.append((i, sum(k in p for p in links), least, i == least))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, links int, node string").repartition(4)


def compare(spark, rows):
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_cell(spark):
    compare(spark, table())


def test_single_precision(spark):
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in table(5)]
    got = vecdedup.near_duplicates(frame(spark, rows).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding", "label"))
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()], key=str) == sorted(brute(rows), key=str)


def test_many_cells_and_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "CELL_ROWS", 10)
    monkeypatch.setattr(vecdedup, "BLOCK_ROWS", 4)
    compare(spark, table(9))


def test_places_cover_every_possible_home():
    r = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(r.normal(size=(3000, 8)))
    c = vecdedup.spherical_kmeans(x, 40)
    y = unit(x + r.normal(size=x.shape) * 0.06)
    near = (x * y).sum(axis=1) >= 0.98
    assert near.sum() > 500
    home, more = vecdedup.places(x, c, 0.98)
    other, again = vecdedup.places(y, c, 0.98)
    met = (home == other) | more[np.arange(len(x)), other] | again[np.arange(len(x)), home]
    assert met[near].all()
    assert more.mean() < 0.6  # and cells are skipped


def test_empty_and_all_invalid(spark):
    assert vecdedup.near_duplicates(frame(spark, table()[:1]).limit(0)).count() == 0
    got = vecdedup.near_duplicates(frame(spark, [(1, None, 3), (2, [0.0], 3)])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_extreme_components(spark):
    """Directions count, however large or small the components."""
    scales = [1.0, 1e200, 1e-200, 5e-324 * 2**20, 1e308]
    rows = [(k, [a * 0.6, a * -0.8, 0.0], 1) for k, a in enumerate(scales)] + [(9, [0.8e200, 0.6e200, 0.0], 1), (10, [0.0, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {**dict.fromkeys(range(5), (4, 0)), 9: (0, 9), 10: (0, 10)}
