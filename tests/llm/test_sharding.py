import zlib
from collections import Counter

import numpy as np
import pytest

from tailframe.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 64, 65, 1000, 4097])
def test_permutation_is_one(n):
    p = sharding.Permutation(n, seed=n)
    y = p(np.arange(n))
    assert sorted(y.tolist()) == list(range(n))
    assert p.inverse(y).tolist() == list(range(n))
    with pytest.raises(ValueError):
        p(np.array([n]))


def test_the_order_looks_random():
    n = 20_000
    y = sharding.Permutation(n, 1)(np.arange(n))
    assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.03
    assert (np.diff(y) == 1).mean() < 0.01
    assert (y != sharding.Permutation(n, 2)(np.arange(n))).mean() > 0.99


def test_shards(docs, cases):
    got = sharding.shard(docs).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in cases)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    p = sharding.Permutation(len(cases), 20_240_607)
    assert all(p(np.array([r.row_number]))[0] == r.shard + 8 * r.slot for r in got)


def test_partitions_do_not_matter(docs):
    a, b = (sorted(map(tuple, sharding.shard(d).collect()), key=str) for d in (docs, docs.repartition(2)))
    assert a == b


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard(docs), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == docs.count()


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0
