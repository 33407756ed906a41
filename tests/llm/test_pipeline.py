import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tailframe.llm import quality
from tailframe.llm.queries import ORACLES, QUERIES, tokenizer_path

from .test_mixing import brute as brute_mix
from .test_quality import corpus
from .test_simhash import brute_kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, cases):
    import random

    at = tmp_path_factory.mktemp("tables")
    rows = corpus(random.Random(8), 80)
    docs = [(i, t, s, "en", len(t or "")) for i, t, s in cases] + [(2000 + i, t, f"s{i % 4}", "en", len(t)) for i, t, _ in rows]
    docs.append((3000, rows[1][1] + " \n", "s9", "en", 1))
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(2000 + i, y, 0) for i, _, y in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), [(i, t, s) for i, t, s, _, _ in docs]


def test_run_matches_brute_force(spark, folder):
    from tokenizers import Tokenizer

    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    weights = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = [r for r in rows if quality.measure(r[1], weights, 0.5)[-1]]
    assert 0 < len(good) < len(rows)
    one = {c: next(r for r in good if r[0] == c) for c in brute_kept(good)}
    assert len(one) < len(good)
    taken = {i: copies for i, _, _, _, copies, _ in brute_mix(list(one.values()))[0]}
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t, s in one.values():
        ids = library.encode(t, add_special_tokens=False).ids
        want += [(i, s, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids))] * taken[i]
    got = [(r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, at).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "mix", "bpe"]


CLASHES = ["n_words", "kept", "base_failed", "content_share", "fingerprint", "fp", "component_id", "root", "place", "node", "id", "row", "size", "source_size", "target", "taken", "threshold", "bucket", "w", "key", "a", "b", "x"]


def test_stages_take_extra_columns_with_any_name(spark, folder):
    """Columns named as the stages' own pass through and change nothing."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, folder[0])
        assert got.columns == more.columns, name
        rows = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES), name
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in stage(spark, docs, folder[0]).collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, more, folder[0]).columns == corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).columns


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_registered_queries():
    assert [q for q in QUERIES if q.startswith("op")] == sorted((q for q in QUERIES if q.startswith("op")), key=lambda q: int(q[2:].split("_")[0]))
    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)
