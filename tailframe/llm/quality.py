"""Quality rules: a linear-chain conditional random field labels each line content or
boilerplate; the share of words in content lines decides whether a text is kept.

The field has one feature group for each line property, a bias, and transitions. Labels are known
for documents and not for lines, so it is fitted by hard expectation maximisation: each labelled
document's lines get their best labels under the present weights and the constraint that the
document's label sets (half of a good document's words or more stand in content lines, less than
half of a poor one's), then weights are fitted to these line labels. Documents of both kinds so
have lines of both kinds, and the transitions are learnt from sequences that switch. The start,
and the model if there are no labels, is PRIOR: plain expectations about junk.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, ship

CONTENT, BOILER = 1, 0
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SENTENCE_ENDS = tuple(c.encode() for c in ".?!:;…。？！")

#: Line properties: name and upper bounds of all buckets but the last.
GROUPS: list[tuple[str, tuple[float, ...]]] = [
    ("words", (1, 3, 7, 15, 39)),
    ("symbols per byte", (0, 0.01, 0.03, 0.08)),
    ("upper-case words", (0, 0.2, 0.5)),
    ("exclamation marks per word", (0, 0.1, 0.5)),
    ("words of punctuation only", (0, 0.1, 0.3)),
    ("digits per byte", (0, 0.05, 0.2)),
    ("bytes per word", (3, 5, 8, 12)),
    ("distinct words", (0.3, 0.6, 0.9)),
    ("equal to an earlier line", (0,)),
    ("ends without a sentence end", (0,)),
]
OFFSETS = [0, *accumulate(len(b) + 1 for _, b in GROUPS)]
N_FEATURES = OFFSETS[-1]

#: Documents in the training sample, at most; lines of a training row (longer texts are several rows);
#: and training rows, at most: those with the smallest hashes, wherever they stand in their texts.
SAMPLE_DOCS, ROW_LINES, SAMPLE_ROWS = 2000, 100, 4000
#: Passes over the training rows.
PASSES = 4


def prior() -> np.ndarray:
    """Weights for content against boilerplate before any label is seen: a bias for content,
    and penalties for lines full of symbols, capitals, exclamations or bare punctuation.
    Layout: features, bias, then the gain of staying content and of staying boilerplate."""
    w = np.zeros(N_FEATURES + 3)
    for group, tail in (("symbols per byte", (-1.0, -3.0)), ("upper-case words", (-2.0,)), ("exclamation marks per word", (-2.0,)), ("words of punctuation only", (-1.5, -3.0))):
        k = next(i for i, (name, _) in enumerate(GROUPS) if name == group)
        w[OFFSETS[k + 1] - len(tail) : OFFSETS[k + 1]] = tail
    w[N_FEATURES] = 2.0
    w[N_FEATURES + 1 :] = 0.5
    return w


def line_features(lines: list[bytes]) -> tuple[list[list[int]], list[int], int]:
    """Feature indexes and word counts of the lines that have a word, and how many of
    them equal an earlier line."""
    out, sizes, seen, repeats = [], [], set(), 0
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        size = len(line)
        inked = sum(map(len, words))
        values = (
            n,
            (size - len(line.translate(None, b"#*$%&|<>"))) / size,
            sum(map(bytes.isupper, words)) / n,
            line.count(b"!") / n,
            (n - len(line.translate(None, _PUNCT).split())) / n,
            (size - len(line.translate(None, b"0123456789"))) / size,
            inked / n,
            len(set(words)) / n,
            int(again),
            int(not words[-1].endswith(_SENTENCE_ENDS)),
        )
        row = []
        for (_, bounds), offset, value in zip(GROUPS, OFFSETS, values, strict=False):
            k = 0
            for b in bounds:
                if value <= b:
                    break
                k += 1
            row.append(offset + k)
        out.append(row)
        sizes.append(n)
    return out, sizes, repeats


def viterbi(scores: list[float], stay_content: float, stay_boiler: float) -> list[int]:
    """The best labels, given what each line gains by being content; content wins ties."""
    back, c, b = [], 0.0, 0.0
    for k, s in enumerate(scores):
        if k:
            from_c, from_b = c + stay_content >= b, b + stay_boiler > c
            back.append((from_c, from_b))
            c, b = max(c + stay_content, b), max(b + stay_boiler, c)
        c += s
    label = CONTENT if c >= b else BOILER
    out = [label] if scores else []
    for from_c, from_b in reversed(back):
        label = (CONTENT if from_c else BOILER) if label == CONTENT else (BOILER if from_b else CONTENT)
        out.append(label)
    return out[::-1]


def constrained(scores: np.ndarray, sizes: np.ndarray, good: bool, stay_content: float, stay_boiler: float, least_share: float = 0.5) -> list[int]:
    """The best labels with at least (good) or less than (not good) least_share of the words in content
    lines. A word's gain for the asked side is doubled until the constraint holds."""
    push, words = 0.0, max(int(sizes.sum()), 1)
    while True:
        shifted = scores + (push if good else -push) * sizes
        labels = viterbi(shifted.tolist(), stay_content, stay_boiler)
        if (int(sizes[np.array(labels) == CONTENT].sum()) >= least_share * words) == good or push > 1e6:
            return labels
        push = max(2 * push, 0.01)


def train_lines(sequences: list[np.ndarray], sizes: list[np.ndarray], labels: list[int], passes: int = PASSES) -> np.ndarray:
    """Weights from sequences (arrays of lines x feature groups), the words of their lines and their
    documents' labels (1: good)."""
    w = prior()
    if not sequences or len(set(labels)) < 2:
        return w
    for _ in range(passes):
        found = [np.array(constrained(w[x].sum(axis=1) + w[N_FEATURES], n, y == 1, w[N_FEATURES + 1], w[N_FEATURES + 2])) for x, n, y in zip(sequences, sizes, labels, strict=True)]
        w = fit(sequences, found, w)
    return w


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], start: np.ndarray | None = None, penalty: float = 0.1, rounds: int = 100, rate: float = 0.1) -> np.ndarray:
    """Weights that maximise the penalised conditional likelihood of the line labels (1: content) of
    sequences (arrays of lines x feature groups). The penalty pulls towards the prior."""
    w0 = prior()
    if not sequences:
        return w0
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sequences, labels = [sequences[k] for k in order], [labels[k] for k in order]
    lengths = np.array([len(s) for s in sequences])
    # Lines in order of their place in the sequence; the longest come first, so the lines of step t
    # are a slice, and the line before the k-th of a step is the k-th of the step before.
    step_of = np.concatenate([np.arange(n) for n in lengths])
    by_step = np.argsort(step_of, kind="stable")
    x, y = np.concatenate(sequences)[by_step], np.concatenate(labels)[by_step]
    alive = np.bincount(step_of)
    cuts = np.concatenate([[0], np.cumsum(alive)])
    steps = [(slice(cuts[t - 1], cuts[t - 1] + alive[t]), slice(cuts[t], cuts[t + 1])) for t in range(1, len(alive))]
    later = np.arange(alive[0], len(x))
    earlier = later - np.repeat(alive[:-1], alive[1:])
    sequence_of = np.concatenate([np.arange(n) for n in alive])
    w = (w0 if start is None else start).copy()
    m, v = np.zeros_like(w0), np.zeros_like(w0)
    flat = x.ravel()
    seen = np.bincount(x[y == CONTENT].ravel(), minlength=N_FEATURES).astype(float)  # features of content lines as labelled
    pairs = np.array([((y[later] == k) & (y[earlier] == k)).sum() for k in (CONTENT, BOILER)], dtype=float)
    bias = float((y == CONTENT).sum())
    for step in range(1, rounds + 1):
        s = w[x].sum(axis=1) + w[N_FEATURES]
        c, b = w[N_FEATURES + 1], w[N_FEATURES + 2]
        ac, ab = s.copy(), np.zeros(len(s))  # forward log sums of content, boilerplate
        for old, new in steps:
            ac[new] = np.logaddexp(ac[old] + c, ab[old]) + s[new]
            ab[new] = np.logaddexp(ab[old] + b, ac[old])
        bc, bb = np.zeros(len(s)), np.zeros(len(s))
        for old, new in reversed(steps):
            bc[old] = np.logaddexp(c + s[new] + bc[new], bb[new])
            bb[old] = np.logaddexp(b + bb[new], s[new] + bc[new])
        first = slice(0, alive[0])
        z = np.logaddexp(ac[first] + bc[first], ab[first] + bb[first])[sequence_of]
        p = np.exp(ac + bc - z)
        expected = np.bincount(flat, weights=np.repeat(p, len(GROUPS)), minlength=N_FEATURES)
        stay = [np.exp(ac[earlier] + c + s[later] + bc[later] - z[later]).sum(), np.exp(ab[earlier] + b + bb[later] - z[later]).sum()]
        slope = np.concatenate([seen - expected, [bias - p.sum()], pairs - stay]) / len(x) * 100 - penalty * (w - w0)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> list[float]:
    """Weights fitted on at most sample_docs labelled documents, the first by a hash of their id. Their
    texts are cut into rows of ROW_LINES lines with a word, from first to last; sample_rows of
    them at most, the first by a hash, reach the driver as line features and word counts (a
    megabyte for a thousand rows). An id with several labels has the lowest; of several texts with
    one id the least is used. Ids without a text, null ids and null labels are left out; texts
    without words have no rows. With no label of one kind left, the weights are the prior's."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))

    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x, sizes, _ = line_features((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n"))
                cuts = range(0, len(x), ROW_LINES)
                features = [np.array(x[k : k + ROW_LINES], dtype=np.uint8).tobytes() for k in cuts]
                words = [np.array(sizes[k : k + ROW_LINES], dtype="<i4").tobytes() for k in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), pa.array(words, pa.binary()), pa.array([y] * len(cuts), pa.int32())], names=["x", "sizes", "y"])

    found = rows.select("text", "y").mapInArrow(run, "x binary, sizes binary, y int")
    got = found.orderBy(F.xxhash64("x", "sizes", "y"), "x", "sizes", "y").limit(sample_rows).toArrow()
    x = [np.frombuffer(f, dtype=np.uint8).reshape(-1, len(GROUPS)).astype(np.int64) for f in got.column("x").to_pylist()]
    sizes = [np.frombuffer(f, dtype="<i4") for f in got.column("sizes").to_pylist()]
    return train_lines(x, sizes, [int(y > 0) for y in got.column("y").to_pylist()]).tolist()


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more in the text. Windows with
    equal 64-bit hashes are compared as text."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    if n <= width:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = list(zip([0, *ends], ends[width - 1 :], strict=False))
    hashes = np.array([xxh3_64_intdigest(whole[a : b - 1]) for a, b in spans], dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    texts: dict[bytes, int] = {}
    for k in maybe:
        a, b = spans[k]
        texts[whole[a : b - 1]] = texts.get(whole[a : b - 1], 0) + 1
    cover = np.zeros(n + 1, dtype=np.int64)
    for k in maybe:
        a, b = spans[k]
        if texts[whole[a : b - 1]] > 1:
            cover[k] += 1
            cover[k + width] -= 1
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(text: str | None, weights: list[float], least_share: float) -> tuple:
    """All that judge() adds, in its order."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    features, sizes, repeats = line_features(raw.split(b"\n"))
    scores = [sum(map(weights.__getitem__, f)) + weights[N_FEATURES] for f in features]
    labels = viterbi(scores, weights[N_FEATURES + 1], weights[N_FEATURES + 2])
    n = len(words)
    content = sum(s for s, y in zip(sizes, labels, strict=True) if y == CONTENT)
    repeated = repeated_words(words)
    failed = n < 20 or 100 * repeated > 30 * n
    share = content / n if n else 0.0
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeats, repeated, failed, share, not failed and share >= least_share


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def judge(df: DataFrame, weights: list[float], least_share: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with word, symbol and repetition counts, base_failed, content_share and kept.

    A null or empty text has no words: all counts 0, share 0, base_failed, not kept. Blank lines
    aren't labelled. Texts of any length are read whole, one at a time. Rows are independent: repeated rows get equal results. Input columns
    with the names of the new ones (in any case) are replaced; an empty table gives an empty one.
    """

    def make():
        def run(cols):
            got = [measure(t, weights, least_share) for t in cols[0].to_pylist()]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            return [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]

        return run

    return map_texts(df, make, [text_col], FIELDS, keep)


def keep_good(df: DataFrame, weights: list[float], least_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df that judge() keeps, with df's columns and no other. Null and empty texts go, as they
    fail the base rules; rows are judged each by itself, so of equal rows all stay or all go. Columns of
    any name stay as they are. An empty table gives an empty one."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return judge(row, weights, least_share, "text", ["row"]).where("kept").select("row.*")


def base_oracle() -> str:
    """DuckDB SQL for judge()'s counts and base_failed, which don't depend on the weights."""
    word = r"[^\x20\x09-\x0D]+"
    window = " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, 8))])
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{word}')) AS x, generate_subscripts(regexp_extract_all(text, '{word}'), 1) AS i FROM t),
g AS (SELECT doc_id, i, {window} AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) r(k) GROUP BY 1),
sized AS (SELECT doc_id, count(*) AS n_words, sum(length(x))::BIGINT AS word_chars FROM w GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{word}') GROUP BY 1),
counted AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'gs')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM t LEFT JOIN sized USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted"""
