import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tailframe.llm import simhash
from tailframe.llm.graph import components, forest


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_groups(rows, fingerprint=brute_fingerprint, distance=2):
    """(id, fingerprint) of each row -> smallest id of its group."""
    fps = sorted({fingerprint(t) for _, t, *_ in rows})
    root = dict(forest([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance]))
    least = defaultdict(list)
    for i, t, *_ in rows:
        fp = fingerprint(t)
        least[root.get(fp, fp)] += [i] if i is not None else []
    return [(i, f"{fingerprint(t):016x}", min(least[root.get(fingerprint(t), fingerprint(t))], default=None)) for i, t, *_ in rows]


def test_groups_match_brute_force(docs, cases):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_groups(cases), key=str)


def brute_words(text, seed=42):
    count, words = [0] * 64, set((text or "").encode().lower().split())
    for w in words:
        h = xxhash.xxh64_intdigest(w, seed=seed)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(words))


def brute_kept(rows):
    """The smallest id of each group of links by any of the three fingerprints."""
    node = {t: (brute_fingerprint(t), brute_words(t, 42), brute_words(t, 43)) for _, t, *_ in rows}
    every = sorted(set(node.values()))
    near = lambda a, b: any((x ^ y).bit_count() <= d for x, y, d in zip(a, b, (2, 3, 3), strict=True))
    root = dict(forest([(a, b) for a in every for b in every if a < b and near(a, b)]))
    least = defaultdict(list)
    for i, t, *_ in rows:
        least[root.get(node[t], node[t])] += [i] if i is not None else []
    return {min(ids, default=None) for ids in least.values()}


def test_one_document_of_each_group_stays(docs, cases):
    got = simhash.keep_one(docs, wider_seeds=())
    assert got.columns == docs.columns
    narrow = {c for _, _, c in brute_groups(cases)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(narrow)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute_kept(cases))
    assert len(brute_kept(cases)) < len(narrow)


def test_copies_with_changed_words_go_and_others_stay(spark):
    r = random.Random(11)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for k in range(60):
        words = [r.choice(lexicon) for _ in range(300)]
        rows.append((k, " ".join(words)))
        if k < 20:
            for j in r.sample(range(300), 4):
                words[j] = r.choice(lexicon)
            rows.append((1000 + k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept, narrow = ({x.doc_id for x in simhash.keep_one(table, wider_seeds=s).collect()} for s in (simhash.WIDER_SEEDS, ()))
    assert set(range(60)) <= kept < narrow
    # Four changes are a five-word similarity of about 0.87: most of these copies go.
    assert len(kept) < 60 + 10


def five_words(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_links_are_those_of_the_exact_similarity(spark):
    r = random.Random(12)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    rows = []
    for k in range(40):
        words = [r.choice(lexicon) for _ in range(200)]
        rows.append((k, " ".join(words)))
        # Cut ends: 0.8 and more for the least, less for the others, which a chain may still reach.
        rows += [(100 * (j + 1) + k, " ".join(words[: 200 - cut])) for j, cut in enumerate(r.sample((10, 25, 38, 39, 45, 60), 2))]
    for k in range(10):  # all words, in another order: equal fingerprints of distinct words
        words = rows[3 * k][1].split()
        r.shuffle(words)
        rows.append((1000 + k, " ".join(words)))
    shared = [r.choice(lexicon) for _ in range(150)]  # half of each text is the same passage
    rows += [(2000 + k, " ".join([r.choice(lexicon) for _ in range(150)] + shared)) for k in range(40)]
    sets = {i: five_words(t) for i, t in rows}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = dict(forest([(a, b) for a in sets for b in sets if a < b and near(a, b)]))
    want = {i for i in sets if root.get(i, i) == i}
    assert 40 < len(want) < len(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in simhash.keep_one(table).collect()} == want


def test_places_that_the_hub_does_not_connect(spark, monkeypatch):
    """All links between texts of one meeting place, some of them labelled already, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK_NODES", 8)
    r = random.Random(23)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    least = simhash.minima(texts)
    keys, sketch = simhash.bands(least), least.astype(np.uint8)
    sets = [set(simhash.shingle_digests(t, 5, 42)) for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and set(keys[i]) & set(keys[j])]
    label = [k if k % 3 else 0 for k in range(60)]
    labelled = [(int(b), k, label[k]) for k in range(60) for b in keys[k] if (keys == b).any(axis=1).sum() > 1]
    rows = [(k, texts[k], [int(b) for b in keys[k]], sketch[k].tobytes()) for k in range(60)]
    got = simhash._between(spark.createDataFrame(labelled, "key long, node long, label long"), spark.createDataFrame(rows, "node long, text string, keys array<long>, sketch binary"), 60).collect()
    same = [(k, 0) for k in range(0, 60, 3)]
    roots = lambda pairs: dict(forest(pairs))
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in links}
    assert roots([*same, *(tuple(p) for p in got)]) == roots([*same, *links])
    assert roots([*same, *links]) != roots(same)


@pytest.mark.parametrize("size", [3, 40, 300, 1900, 2100, 4500, 20_000])
def test_stamps_keep_similar_texts_and_rule_out_others(size):
    """Sets at a similarity just at or above the one asked for are never ruled out; those well below are, if dense enough to
    tell. Sizes about a level's bound are held against the next level."""
    r = np.random.default_rng(size)
    kept, passed = [], []
    for ratio, out in ((0.8, kept), (0.68, passed)):
        for _ in range(60):
            both = int(size * 2 * ratio / (1 + ratio))
            while both < (2 * size - both) * ratio:
                both += 1
            ours, theirs = size - both, r.integers(0, size - both + 1) if ratio == 0.8 else size - both
            drawn = [int(x).to_bytes(8, "big") for x in r.integers(0, 1 << 63, both + ours + theirs, dtype=np.uint64)]
            found = [simhash.stamp(drawn[: both + ours]), simhash.stamp(drawn[:both] + drawn[both + ours :])]
            n, stamps = np.array([f[0] for f in found]), np.array([np.frombuffer(f[1], np.uint8) for f in found]).reshape(2, 2, -1)
            out.append(simhash.may_be_similar(n, stamps, 0, np.array([1]))[0])
            assert simhash.may_be_similar(n, stamps, 1, np.array([0]))[0] == out[-1]
    assert all(kept)
    if size >= 1900:
        assert sum(passed) <= 3


def test_half_similar_families_bring_no_texts(spark, monkeypatch):
    """A family at a similarity of about 0.7, in crowded places: the stamps rule out all its pairs before a text moves,
    and what stays is what an exact comparison keeps."""
    r = random.Random(31)
    base = [f"w{k}" for k in range(600)]

    def member():
        words = list(base)
        for k in r.sample(range(600), 11):
            words[k] = f"x{r.randrange(10**9)}"
        return " ".join(words)

    rows = [(k, member()) for k in range(150)]
    sets = {i: five_words(t) for i, t in rows}
    shares = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b]
    assert 0.65 < np.mean(shares) < 0.76 and max(shares) < 0.8
    rows.append((500, rows[3][1] + " end"))
    table, count, stored = spark.createDataFrame(rows, "doc_id long, text string"), {}, simhash.stored

    def counted(df, name, *more, **named):
        out = stored(df, name, *more, **named)
        count[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    assert {x.doc_id for x in simhash.keep_one(table).collect()} == set(range(150))
    assert count["seats"] > 300 and count["met"] < 10


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdef") for _ in range(n)) for n in (1, 2, 3, 15, 16, 17, 40, 100)]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def near_set(r, n, flips):
    base = r.getrandbits(64)
    out = {base}
    while len(out) < n:
        x = base
        for _ in range(r.randrange(flips + 1)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_crowded_places_find_what_pairs_find():
    r = random.Random(4)
    for _ in range(5):
        fps = near_set(r, 400, 4)
        same = [dict(zip(*(x.tolist() for x in simhash.Ring(2, 8, crowded).links(fps)), strict=True)) for crowded in (10_000, 1)]
        label = lambda m: {x: m.get(x, x) for x in fps.tolist()}
        groups = [sorted(sorted(k for k, v in label(m).items() if v == root) for root in set(label(m).values())) for m in same]
        assert groups[0] == groups[1]


def test_no_link_is_lost(spark):
    r = random.Random(7)
    fps = np.concatenate([near_set(r, 120, 5), near_set(r, 60, 3), np.array([r.getrandbits(64) for _ in range(300)], dtype=np.uint64)])
    signed = fps.view(np.int64).tolist()
    edges = simhash.link_edges(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), simhash.Ring(2))
    got = {x.node: x.root for x in components(edges).collect()}
    want = dict(forest([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]))
    assert got == want


def test_components_of_long_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (7001, 7000)]
    random.Random(1).shuffle(pairs)
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    assert got == {k: 0 for k in range(1, 301)} | {k: 1000 for k in range(1001, 1200)} | {7001: 7000}


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
