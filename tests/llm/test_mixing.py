import hashlib
from collections import defaultdict

import duckdb
import pytest

from tailframe.llm import mixing


def brute(rows, seed="mix", weights=(5, 2, 1)):
    sized = [(i, s, len((t or "").encode().split()), int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n, _ in sized:
        total[s] += n
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in total)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:  # the excess of those above their cap is shared again
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * total[s]}
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= above
    taken = []
    for s in names:
        base = int(target[s] // total[s]) if total[s] else 0
        budget, mine = target[s] - base * total[s], defaultdict(list)
        for r in sized:
            if r[1] == s:
                mine[r[3]].append(r)
        run, chosen, full = 0, set(), False
        for h in sorted(mine):
            n = sum(r[2] for r in mine[h])
            if not full and run + n <= budget:
                chosen.add(h)
            elif not full:
                full = True
                if run + n - budget < budget - run:
                    chosen.add(h)
            run += n
        taken += [(r[0], s, r[2], total[s], base + (h in chosen), (base + (h in chosen)) * r[2]) for h in mine for r in mine[h]]
    return taken, target


def test_matches_brute_force(docs, cases):
    want, target = brute(cases)
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.source, r["size"], r.source_size, r.copies, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert all(r.target == pytest.approx(target[r.source]) for r in got)


def test_rows_of_the_mix(docs, cases):
    want, _ = brute(cases)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(i) for i, _, _, _, copies, _ in want for _ in range(copies))


def test_reruns_and_partitions_agree(docs):
    a, b = (sorted(map(tuple, mixing.mix(d).collect()), key=str) for d in (docs, docs.repartition(2)))
    assert a == b


def test_the_plan_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_oracle_agrees(docs, cases):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", cases)
    want = sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(mixing.oracle()).fetchall()), key=str)
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs).collect()), key=str)
    assert got == want


def test_empty_and_wordless(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
