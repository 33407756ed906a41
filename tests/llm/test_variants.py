import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tailframe.llm import variants as V


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in V.RUN.findall((text or "").translate(V.LOWER)):
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(docs):
    words = counted(docs)
    near = {w: [v for v in words if edit_one(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        top = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], form[w] and words[form[w]], root))
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(9)
    stems = ["réponse", "station", "stations", "morning", "ÀÉÎÕÜß", "light×ing"] + ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 9))) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * r.choice([5, 30, 200])
        for _ in range(6):
            k = r.randrange(len(s))
            variant = r.choice([s[:k] + s[k + 1 :], s[:k] + "x" + s[k:], s[:k] + "y" + s[k + 1 :], s[:k] + s[k] + s[k:]])
            words += [variant] * r.choice([1, 5, 6, 40])
            words += [variant + "z"] * r.choice([0, 5])
    words += ["A" * 5000] * 6 + ["A" * 5001] * 40 + ["short"] * 50
    r.shuffle(words)
    rows = [(k, r.choice([" ", "-", "1", "\n"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in words[k::50])) for k in range(50)]
    return [*rows, rows[3], rows[3], (None, rows[4][1]), (60, None), (61, ""), (62, "12 34")]


@pytest.mark.parametrize("block", [V.BLOCK, 3])
def test_equals_brute_force(spark, docs, block):
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, WORD string, n int").repartition(6)
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in V.group_variants(table, block=block).collect())
    want = brute(docs)
    assert got == want
    assert sum(1 for w in want if w[3]) > 20
    assert any(w[3] not in (None, w[5]) for w in want)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert V.group_variants(empty).collect() == []


def test_dense_blocks_equal_edits():
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(5, 8))) for _ in range(80)})
    width = max(map(len, words))
    found, _ = V.near(V.matrices(words, width), V.matrices(words, width))
    assert found.tolist() == [[edit_one(a, b) for b in words] for a in words]


def test_half_of_the_letters_meet():
    """A near pair shares at least half of the longer word's letters at one end."""
    r = random.Random(4)
    for _ in range(500):
        a = "".join(r.choice("abc") for _ in range(r.randrange(6, 12)))
        k = r.randrange(len(a))
        b = r.choice([a[:k] + a[k + 1 :], a[:k] + "z" + a[k + 1 :]])
        half = max(len(a), len(b)) // 2
        assert a[:half] == b[:half] or a[-half:] == b[-half:]


def test_words_drop_a_letter_by_their_hash():
    doc = next(k for k in range(10_000) if crc32(f"{k}:station".encode()) % 199 == 0)
    k = crc32(f"{doc}:station".encode()) % 7
    assert V.words_of(doc, "Station station plains") == {"station"[:k] + "station"[k + 1 :]: 2, "plains": 1}
    assert V.words_of(None, "stations") == V.words_of(None, "STATIONS") or crc32(b":stations") % 199 == 0
    assert np.all(V.matrices(["ab"], 3)[1] == [[98, 97, 0]])
