import random

import pytest

WORDS = "the of and water under river stone light house green song early morning wide open road".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text, source): nulls, empty and blank texts, a long one, copies, near copies, repeated
    rows, specials and letters of many alphabets."""
    r = random.Random(5)
    base = prose(r, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [None, "", " \t\n\r\x0b\x0c", "One", "one two", base, base, base.upper(), " ".join(near), prose(r, 30_000)]
    texts += ["a<|endoftext|>b <|endoftext|", "é漢字😀 ñ\u00a0x\u2003y\x1cz", "don't we'll 12345 !!! ...\n\n\n   end  ", "x" * 5000]
    texts += [prose(r, r.randrange(1, 300)) for _ in range(40)]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, base, None), (None, None, None), (900, "lone text here", None)]


@pytest.fixture(scope="session")
def docs(spark, cases):
    """The cases as a table with columns whose names clash with those of the operators."""
    rows = [(i, t, s, "x", 1.5, True, "row") for i, t, s in cases]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, N_TOKENS string, fp double, kept boolean, copies string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
