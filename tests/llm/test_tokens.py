import hashlib
import json
import random

import pytest

from tailframe.llm import bpe, tokencount
from tailframe.llm.queries import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def noise(r, n):
    return "".join(r.choice(["<|endoftext|>", "<|endof", "a", " ", "   ", "\n", "'s", "'r", "é", "😀", "12", "...", "hello ", "x" * 30, " " * 30]) for _ in range(n))


def test_counts_match_the_library(docs, cases, library):
    got = {(r.doc_id, r.N_TOKENS if "N_TOKENS" in r else None, r.n_tokens, r.n_bytes, r.over_limit) for r in tokencount.count_tokens(docs, PATH, keep=["doc_id"]).collect()}
    want = {(i, None, len(library_ids(library, t)), len((t or "").encode()), len(library_ids(library, t)) > 1024) for i, t, _ in cases}
    assert got == want


def test_clashing_columns_are_replaced(docs):
    out = tokencount.count_tokens(docs, PATH)
    assert out.columns == ["doc_id", "text", "source", "fp", "kept", "copies", "n_bytes", "n_tokens", "over_limit"]
    assert out.count() == docs.count()


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 20), (100, 8), (50, 40)])
def test_chunks_splice_exactly(library, chunk, overlap):
    r = random.Random(chunk)
    counter = tokencount.Counter(PATH, chunk, overlap)
    texts = [noise(r, r.randrange(120)) for _ in range(300)] + ["a" * 900, " " * 700, "\n" * 300 + "b"]
    assert counter.count(texts) == [len(library_ids(library, t)) for t in texts]
    assert counter.widened  # the alignment fails now and then, and the overlap grows


def test_round_trip(docs, cases, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.round_trip(docs, PATH, keep=["doc_id"], with_ids=True).collect())
    want = []
    for i, t, _ in cases:
        ids = library_ids(library, t)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want)


def test_trie_walk_equals_the_library_on_noise(library):
    r = random.Random(2)
    codec = bpe.Codec(PATH, cache_words=50)
    texts = [noise(r, r.randrange(60)) for _ in range(400)] + [chr(c) * 2 + "a" + chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        assert codec.encode_batch(part) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_states_that_no_word_needs_are_not_computed(library, monkeypatch):
    """A word that is one token asks for no other state; another word with the same start still gets its own."""
    codec, seen = bpe.Codec(PATH), []
    plain = codec.compatible
    monkeypatch.setattr(codec, "compatible", lambda a, b: seen.append((a, b)) or plain(a, b))
    assert codec.encode_batch([" information"]) == [library_ids(library, " information")]
    assert seen == []
    words = [" information", " informatoin", " informatoinzzqx", " inform", "zzqxinformation" * 40]
    assert codec.encode_batch(words) == [library_ids(library, w) for w in words]


def test_decoding_any_ids(spark, library):
    r = random.Random(3)
    rows = [(k, [r.randrange(50257) for _ in range(9)]) for k in range(50)] + [(99, None), (98, [])]
    got = {x.k: x.decoded for x in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()}
    assert got == {k: library.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def test_empty_tables(no_docs):
    assert tokencount.count_tokens(no_docs, PATH).count() == 0
    assert bpe.round_trip(no_docs, PATH).count() == 0
    assert bpe.encode(no_docs, PATH).count() == 0


def test_other_vocabulary_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="normalizer, pre_tokenizer, decoder, end_of_word_suffix"):
        bpe.Codec(tokenizer_path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    spec["model"]["ignore_merges"] = True
    with pytest.raises(ValueError, match="ignore_merges, added token with lstrip"):
        bpe.check_supported(spec)
