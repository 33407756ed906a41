import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tailframe.llm import brownlm


def tokens(text):
    return [*(text or "").encode().lower().split(), brownlm.END]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_base_matches_brute_force(docs, cases, monkeypatch):
    monkeypatch.setattr(brownlm, "CHUNK_WORDS", 500)
    count = Counter(w for i, t, _ in cases if not is_held_out(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = []
    for i, t, _ in cases:
        w = tokens(t)
        want.append((str(i), is_held_out(i), len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)))
    got = brownlm.score_texts(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def grammar(seed, n):
    """Two vocabularies; words of one follow each other."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        side = "abcdefgh" if k % 2 else "stuvwxyz"
        rows.append((k, " ".join(r.choice(side) + r.choice(side) for _ in range(60)), "s"))
    return rows


def test_classes_beat_the_base_on_held_out_texts(spark):
    got = brownlm.score_texts(spark.createDataFrame(grammar(1, 300), "doc_id long, text string, source string"), classes=4).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 10
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.25 * sum(r.n_tokens for r in held)


class Brute:
    """The whole model of a small corpus in plain loops; only the exchange is brownlm's own, and that is
    tested by itself below."""

    def __init__(self, rows, frequent, classes):
        self.k = classes
        learned = [tokens(t) for i, t in rows if not is_held_out(i)]
        self.n = n = Counter(w for t in learned for w in t)
        words = sorted((w for w in n if w != brownlm.END), key=lambda w: (-n[w], zlib.crc32(w)))[:frequent]
        words = [brownlm.END, *sorted(words, key=lambda w: (-n[w], w))]
        unit = {w: k for k, w in enumerate(words)}
        m = np.zeros((len(words), len(words)), dtype=np.int64)
        pairs = [(v, w) for t in learned for v, w in zip([brownlm.END, *t], t, strict=False)]
        for v, w in pairs:
            if v in unit and w in unit:
                m[unit[v], unit[w]] += 1
        first = dict(zip(words, brownlm.exchange(m, classes).tolist(), strict=True))
        c = np.zeros((classes, classes))
        for v, w in pairs:
            if v in unit and w in unit:
                c[first[v], first[w]] += 1
        share = c.sum(axis=0) / c.sum()
        p = (c + 20 * share) / (c.sum(axis=1, keepdims=True) + 20)
        near = {w: [] for w in n}
        for v, w in pairs:
            if v in unit:
                near[w].append(lambda g, v=v: math.log(p[first[v], g] / share[g]) if share[g] else 0.0)
            if w in unit:
                near[v].append(lambda g, w=w: math.log(p[g, first[w]] / share[first[w]]) if share[first[w]] else 0.0)
        gain = lambda w, g: sum(f(g) for f in near[w]) + 1e-6 * share[g]
        self.label = {w: first[w] if w in first else max(range(1, classes), key=lambda g: gain(w, g)) for w in n}  # noqa: B023
        self.c = np.zeros((classes, classes))
        for v, w in pairs:
            self.c[self.label[v], self.label[w]] += 1
        self.total = self.c.sum(axis=0)
        once = np.array([sum(n[w] == 1 and self.label[w] == g for w in n) for g in range(classes)])
        self.unseen = np.array([min(0.5, once[g] / max(self.total[g], 1)) for g in range(classes)])
        freq = self.total / self.total.sum()
        self.p = (self.c + 20 * freq) / (self.c.sum(axis=1, keepdims=True) + 20)
        self.as_history = int(np.argmax(once))

    def log_p(self, v, w):
        a = self.label.get(v, self.as_history)
        if w not in self.n:
            return math.log10(sum(self.p[a, g] * self.unseen[g] for g in range(self.k)) + 1e-12)
        g = self.label[w]
        return math.log10(self.p[a, g] * (1 - self.unseen[g]) * self.n[w] / self.total[g])

    def score(self, text):
        t = tokens(text)
        return sum(self.log_p(v, w) for v, w in zip([brownlm.END, *t], t, strict=False))


def zipf(seed, n):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.8))}"
    rows = [(k, " ".join(word() for _ in range(r.randrange(0, 60)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, "new words only here"), (n + 2, rows[3][1]), (n + 3, " ".join(word() for _ in range(900)))]


@pytest.mark.parametrize(("chunk", "frequent", "classes"), [(10**6, 25, 6), (300, 25, 6), (70, 8, 4), (300, 10**5, 5)])
def test_scores_match_brute_force(spark, monkeypatch, chunk, frequent, classes):
    """Also with small chunks, so that words meet across chunks and one text is cut into several."""
    monkeypatch.setattr(brownlm, "CHUNK_WORDS", chunk)
    rows = zipf(4, 120)
    brute = Brute(rows, frequent, classes)
    got = brownlm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frequent=frequent, classes=classes).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in got) == [(i, len(tokens(t)), sum(w in brute.n for w in tokens(t))) for i, t in rows]
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: brute.score(t) for i, t in rows}, rel=1e-9)


def test_the_model_is_a_distribution():
    """After every word, known words and the unknown one add up to 1."""
    brute = Brute(zipf(2, 60), 20, 5)
    m = brownlm.model_of(brute.c.astype(np.int64), np.array([sum(brute.n[w] == 1 and brute.label[w] == g for w in brute.n) for g in range(5)]), 0)
    for before in range(5):
        p = sum(10 ** (m.transition[before, brute.label[w]] + m.emission[brute.label[w]]) * n for w, n in brute.n.items())
        assert p + 10 ** m.unknown[before] == pytest.approx(1, abs=1e-6)


def test_most_frequent_words_are_those_of_the_limit(spark):
    n = {f"w{k}".encode(): 1 + 1000 // (k + 1) for k in range(300)} | {b"x" * 65: 10**6}
    counts = spark.createDataFrame(list(n.items()), "word binary, n long")
    del n[b"x" * 65]
    order = sorted(n, key=lambda w: (-n[w], zlib.crc32(w)))
    for limit in (0, 1, 5, 40, 150, 299, 300, 1000):
        assert brownlm.most_frequent(counts, limit) == {w: n[w] for w in order[:limit]}
    same = spark.createDataFrame([(f"v{k}".encode(), 7) for k in range(50)], "word binary, n long")
    assert len(brownlm.most_frequent(same, 20)) == 20


def objective(m, label, k):
    e = np.eye(k)[label]
    c = e.T @ m @ e
    g = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return g(c) - g(c.sum(axis=0)) - g(c.sum(axis=1))


def test_exchange_reaches_a_local_optimum():
    r = np.random.default_rng(3)
    m = r.poisson(2.0, size=(14, 14)) * (1 + 3 * (np.arange(14)[:, None] % 3 == np.arange(14)[None, :] % 3))
    label = brownlm.exchange(m, 4, sweeps=50)
    best = objective(m.astype(float), label, 4)
    assert label[0] == 0
    assert 0 not in label[1:]
    for w, b in itertools.product(range(1, 14), range(1, 4)):
        other = label.copy()
        other[w] = b
        assert objective(m.astype(float), other, 4) <= best + 1e-6


def test_transitions_are_distributions():
    c = np.random.default_rng(1).poisson(3.0, size=(6, 6)).astype(float)
    c[2] = 0
    assert np.allclose(brownlm.transitions(c).sum(axis=1), 1)


def test_no_rows_and_nothing_to_learn_from(spark, no_docs):
    assert brownlm.score_texts(no_docs).count() == 0
    held = next(i for i in range(1000) if is_held_out(i))
    got = brownlm.score_texts(spark.createDataFrame([(held, "a b", "s")], "doc_id long, text string, source string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.held_out) for r in got] == [(3, 0, 0, True)]
    assert math.isfinite(got[0].score)
