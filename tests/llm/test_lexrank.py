import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tailframe.llm import lexrank as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    n, total = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in held:
            tf, m = Counter(w), 100 - 75 + (75 * len(w) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def data():
    r = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["Été", "naïve", "漢字", "x9"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "_", "/"]) for _ in range(n))
    docs = [(k, text(r.randrange(1, 80))) for k in range(300)]
    docs += [(400 + k, docs[7][1]) for k in range(30)] + [docs[7], (None, docs[7][1]), (900, None), (901, ""), (902, "!?"), (903, text(20_000))]
    items = [(k, text(r.randrange(1, 40))) for k in range(20)] + [(50, docs[7][1]), (50, docs[7][1]), (None, "w1 w1 w2"), (51, None), (52, "--"), (53, "unknown words"), (54, "W1 w1 W1")]
    return docs, items


@pytest.fixture
def small_tiles(monkeypatch):
    for name, value in (("TILE_ITEMS", 6), ("TILE_TERMS", 7), ("TILE_DOCS", 16)):
        monkeypatch.setattr(L, name, value)


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash", 1.0) for x in docs], "doc_id long, text string, SCORE string, n double").repartition(7)
    return d, spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, rank string")


def test_equals_brute_force(spark, data, small_tiles):
    assert rows(L.search(*frames(spark, *data))) == brute(*data)


def test_groups_of_items(spark, data, small_tiles, monkeypatch):
    monkeypatch.setattr(L, "GROUP_TERMS", 100)
    assert rows(L.search(*frames(spark, *data), k=3)) == brute(*data, k=3)


def test_empty_tables(spark, data):
    docs, items = frames(spark, *data)
    assert L.search(docs.limit(0), items).collect() == []
    assert L.search(docs, items.limit(0)).collect() == []
    assert L.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_products_stay_exact():
    weights = np.array([[2.0**31, 2.0**32, 1, 5], [1, 2, 3, 2.0**33]])
    found = L.cuts(weights)
    assert [(r.start, r.stop) for r in found] == [(0, 1), (1, 3), (3, 4)] or all(weights[:, r].sum(axis=1).max() * L.MOST_IMPACT < 2**53 or r.stop - r.start == 1 for r in found)
    assert [i for r in found for i in range(r.start, r.stop)] == [0, 1, 2, 3]
    tile = L.Tile(np.arange(2), np.arange(4), np.ones((2, 4)))
    search = L.Search([tile], np.array([2.0**33, 2.0**31, 7, 11]), 4, 10, 100, 3)
    search.add(np.array([5, 6]), np.array([4, 1]), np.array([0, 4, 5]), np.array([0, 1, 2, 3, 0]), np.array([1, 3, 1, 1, 2]))
    impact = lambda tf, n: (10**9 * tf) // (1000 * tf + 8 * (25 + 75 * n * 10 // 100))
    assert search.scores[0].tolist() == sorted([2**33 * impact(1, 4) + 2**31 * impact(3, 4) + 18 * impact(1, 4), 2**33 * impact(2, 1)], reverse=True)


def test_ties_at_the_edge():
    scores, ids = np.array([5, 7, 5, 0, 5, 5]), np.array([9, 8, 3, 1, 4, 2])
    assert ids[L.best(scores, ids, 3)].tolist() == [8, 2, 3]
    assert L.best(np.zeros(4, int), np.arange(4), 3).tolist() == []
