import itertools
import random
import re

import numpy as np

from tailframe.llm import quality


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts_match_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n\t", "a\x1cb\u00a0c", "one\none\n\n\none two\r\none"]
    texts += ["".join(r.choice(["a ", "b ", "c ", "\n", "# ", "|", " é ", "漢", "\t"]) for _ in range(r.randrange(200))) for _ in range(150)]
    weights = quality.prior().tolist()
    for t in texts:
        assert quality.measure(t, weights, 0.5)[:6] == brute_base(t)


def test_viterbi_finds_the_best_labelling():
    r = random.Random(2)
    for _ in range(60):
        s = [r.uniform(-2, 2) for _ in range(r.randrange(1, 9))]
        a, b = r.uniform(-1, 1), r.uniform(-1, 1)

        def value(y):
            return sum(x for x, k in zip(s, y, strict=True) if k) + sum(a if p and q else 0 if p or q else b for p, q in zip(y, y[1:], strict=False))  # noqa: B023

        best = max(map(value, itertools.product((0, 1), repeat=len(s))))
        assert abs(value(quality.viterbi(s, a, b)) - best) < 1e-9
    assert quality.viterbi([], 0, 0) == []


def junk(r, kind):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(40)]
    return [" ".join(w + r.choice(["***", "$$$", "%%%"]) for w in words), " ".join(w.upper() + "!!" for w in words), " | ".join(words)][kind]


def good(r):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(40)).capitalize() + "."


def corpus(r, n):
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        lines = [junk(r, (k // 4) % 3) if bad and j else good(r) for j in range(5)]
        rows.append((k, "\n".join(lines), 0 if bad else 1))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(3), 240)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:120]] + [(None, 1), (3, None), (5000, 0)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert weights != quality.prior().tolist()
    got = {r.doc_id: r.kept for r in quality.judge(docs, weights, keep=["doc_id"]).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows[120:]) >= 118
    assert all(got[i] for i, _, y in rows[120:] if y)


def test_without_labels_the_prior_rules(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, labels) == quality.prior().tolist()


def test_fit_maximises_the_likelihood():
    """No small step from the fitted weights raises the penalised likelihood, by enumeration."""
    r = random.Random(5)
    sequences = [np.array(quality.line_features([(good(r) if r.random() < 0.5 else junk(r, 1)).encode() for _ in range(r.randrange(1, 5))])[0]) for _ in range(12)]
    labels = [np.array([r.randrange(2) for _ in x]) for x in sequences]
    w0, lines = quality.prior(), sum(map(len, sequences))

    def objective(w):
        total = 0.0
        for x, y in zip(sequences, labels, strict=True):
            s = w[x].sum(axis=1) + w[quality.N_FEATURES]
            value = lambda z: sum(a for a, k in zip(s, z, strict=True) if k) + sum(w[-2] if p and q else 0 if p or q else w[-1] for p, q in zip(z, z[1:], strict=False))  # noqa: B023, E731
            total += value(tuple(y)) - np.logaddexp.reduce([value(z) for z in itertools.product((0, 1), repeat=len(x))])
        return total * 100 / lines - 0.05 * ((w - w0) ** 2).sum()

    w = quality.fit(sequences, labels, rounds=3000, rate=0.02)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-3
        assert abs(objective(w + step) - objective(w - step)) / 2e-3 < 0.05


def test_seams_between_good_and_bad_halves():
    """Fitted on document labels alone, the field finds where a text turns from content to junk."""
    r = random.Random(7)
    docs = [(t, y) for _, t, y in corpus(r, 200)]
    x, sizes = zip(*[quality.line_features(t.encode().split(b"\n"))[:2] for t, _ in docs], strict=True)
    w = quality.train_lines([np.array(f) for f in x], [np.array(n) for n in sizes], [y for _, y in docs])
    right = 0
    for k in range(40):
        halves = [good(r) for _ in range(4)], [junk(r, k % 3) for _ in range(4)]
        lines = [*halves[k % 2], *halves[1 - k % 2]]
        scores = [w[f].sum() + w[quality.N_FEATURES] for f in map(np.array, quality.line_features([a.encode() for a in lines])[0])]
        right += quality.viterbi(scores, w[-2], w[-1]) == [1 - k % 2] * 4 + [k % 2] * 4
    assert right >= 38


def test_constraints_hold():
    r = np.random.default_rng(8)
    for _ in range(50):
        scores, sizes = r.normal(size=9) * 3, r.integers(1, 50, 9)
        for good_one in (True, False):
            y = np.array(quality.constrained(scores, sizes, good_one, 1.0, 1.0))
            assert (sizes[y == 1].sum() * 2 >= sizes.sum()) == good_one
        free = quality.viterbi(scores.tolist(), 1.0, 1.0)
        assert free in [quality.constrained(scores, sizes, g, 1.0, 1.0) for g in (True, False)]


def test_the_sample_is_bounded_and_takes_one_text_an_id(spark):
    rows = corpus(random.Random(9), 60)
    long = "\n".join(good(random.Random(k)) for k in range(450))
    docs = [(i, t) for i, t, _ in rows]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1)], "doc_id long, quality int")
    once = spark.createDataFrame(docs + [(900, long)], "doc_id long, text string")
    often = spark.createDataFrame(docs * 3 + [(900, long)] * 5, "doc_id long, text string")
    assert quality.train(once, labels) == quality.train(often, labels)
    few = quality.train(once, labels, sample_rows=20)
    assert few != quality.train(once, labels)
    assert few == quality.train(once.repartition(7), labels, sample_rows=20)


def test_rows_and_columns(docs, no_docs, cases):
    weights = quality.prior().tolist()
    out = quality.judge(docs, weights)
    assert out.count() == len(cases)
    assert "kept" in out.columns
    assert len([c for c in out.columns if c.lower() == "kept"]) == 1
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns
    want = sorted(str(i) for i, t, _ in cases if quality.measure(t, weights, 0.5)[-1])
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert {r.fp for r in kept.collect()} == {1.5}
    assert quality.judge(no_docs, weights).count() == 0
