import random
import re

import pytest
from pyspark.sql import functions as F

from tailframe.llm import secretscan as S

KEY = "AKIA" + "ABCD1234" * 2
TEXTS = [
    None,
    "",
    "nothing here",
    f"PassWord = 'hunter22' and {KEY}, {KEY}; éé token:abcdef😀 secret=short api_key=\"0123456789abcdef0123456789\"",
    "token=token:abcdefgh",  # the first match takes the second keyword and is dropped
    "token=secret=abcdefgh passwd:  'x'",
    "deadbeef" * 3 + "g" + "deadbeef" * 2 + "A" + "0" * 24,
    "AKIA AKIAAKIA" + "Z" * 15 + " AKIA" + "Z" * 15,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 20 + " xoxb-" + "1" * 12 + " eyJ" + "a" * 12 + "." + "b" * 12 + ".c AIza" + "x" * 35,
    "tok en sec ret pass word",
    "token=a " * 3000 + "token=abcdefgh",
    "x" * 200_000 + " secret: " + "y" * 50_000,
]


def brute(text, rules=S.RULES):
    found = []
    for no, rule in enumerate(rules):
        found += [(m.start(), no, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    return ",".join(f"{rules[no].kind}:{a}:{b}" for a, no, b in sorted(found))


@pytest.mark.parametrize("broadcast_keys", [S.BROADCAST_KEYS, 0])
def test_equals_a_plain_search(spark, broadcast_keys):
    rows = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 2), (None, TEXTS[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, H string, rules int").repartition(4)
    got = S.digests(S.find_secrets(docs, broadcast_keys=broadcast_keys)).collect()
    assert sorted(map(str, [(r.doc_id, r.spans) for r in got])) == sorted(map(str, [(r[0], brute(r[1])) for r in rows]))
    one = next(r for r in got if r.doc_id == 3)
    assert (one.n_assign, one.n_access, one.n_hex) == (3, 2, 1)
    assert next(r for r in got if r.doc_id == 4).n_assign == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(S.find_secrets(empty)).collect() == []


def test_hex_and_access_patterns_equal_the_ones_that_filter_afterwards():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["AKIA", "A", "Z9", "0f", "deadbeefdeadbeef", " ", "g", "é"]) for _ in range(r.randrange(30)))
        for plain, least, rule in ((r"AKIA[A-Z0-9]+", 20, S.BASE[1]), (r"[0-9a-f]+", 24, S.BASE[2])):
            assert [m.span() for m in re.finditer(plain, text) if len(m[0]) >= least] == [m.span() for m in re.finditer(rule.pattern, text)]


def ands(*words):
    return S.Query(frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words))


def test_queries():
    q = {r.kind: S.trigram_query(r.pattern) for r in S.RULES}
    assert q["assign"] == ands("password", "passwd", "secret", "token", "apikey", "api_key")
    assert q["access"] == ands("akia")
    assert q["hex"] == S.ANY
    assert q["signed_json"] == ands("eyj")
    assert q["chat"] == ands(*(f"xox{c}-" for c in "abprs"))
    assert S.trigram_query("a.*bcde(fg)?h+") == S.Query([frozenset(["bcd", "cde", "deh"]), frozenset(["bcd", "cde", "fgh"])])
    assert S.trigram_query("(abc|.)") == S.ANY
    assert S.trigram_query("(?:abcd|xyz)\\bq") == ands("abcdq", "xyzq")
    assert S.trigram_query("[^a]bcd") == ands("bcd")
    assert S.trigram_query("(ab){2}") == ands("abab")
    assert S.trigram_query("(abc)*") == S.ANY


@pytest.mark.parametrize("pattern", [r.pattern for r in S.RULES] + ["ab(c|de)+f?g{2,4}", "x[yz]{1,2}(hello|h[aou]llo){3}", "(foo|bar)?baz", "a{3}b*c{5}", "q(?=u)u[aeiou]."])
def test_a_match_satisfies_the_query(pattern):
    """Random strings that match: every one holds an AND of the query."""
    r = random.Random(pattern)
    query = S.trigram_query(pattern)

    def any_of(tree):
        out = ""
        for op, v in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(v)
            elif name == "IN":
                kind, x = r.choice(v)
                out += chr(x if str(kind) == "LITERAL" else r.randint(*x))
            elif name == "SUBPATTERN":
                out += any_of(v[3])
            elif name == "BRANCH":
                out += any_of(r.choice(v[1]))
            elif name == "MAX_REPEAT":
                out += "".join(any_of(v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 4))))
            elif name == "ANY":
                out += r.choice("abc")
        return out

    for _ in range(200):
        text = any_of(S.parser.parse(pattern))
        if re.search(pattern, text):
            assert any(all(g in text.lower() for g in a) for a in query)


def test_only_candidates_are_searched(spark):
    texts = spark.createDataFrame([(1, "my token is lost"), (2, "no such word"), (3, "to ken oke"), (4, "my token is lost")], "h long, text string")
    query = S.trigram_query("token[a-z ]+")
    grams = sorted({g for a in query for g in a})
    index = S.build_index(texts, grams, 4)
    assert {r.h: r.rules for r in S.candidates(index, {2: query}, grams).collect()} == {1: 4, 4: 4}
    assert index.select(F.explode("postings")).count() == len(grams)
