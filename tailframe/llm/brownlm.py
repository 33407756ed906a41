"""Brown class-based n-grams: word classes by exchange clustering, and a smoothed class bigram
that scores texts.

The corpus is tokenized once, into chunks that hold a dictionary of their distinct words and
their documents as dictionary indexes. Everything after is done on dictionaries and on arrays
of indexes.

Classes are found in two steps. The most frequent words (FREQUENT of them; at any size they are half
of a corpus and most of every word's neighbours) are moved by exchange on the matrix of their
bigrams until none moves. Then every other word of the corpus is moved once, against these frozen
classes: its neighbours' classes are counted over all training documents (an aggregate of words by
classes), and it goes to the class that raises the likelihood of the class bigram most. So each
word that was ever trained on has a class by its own contexts, and the number of classed words
grows with the corpus. Class bigrams are then counted over all training tokens.

Model: P(w | v) = P(class of w | class of v) * P(w | class of w). Transitions are interpolated
with class frequencies. Each class keeps the share of its tokens that are words seen once
(Good-Turing) for words never seen; a text's unknown words are one outcome, as in the base
model, so both are distributions over the known words, the end and "unknown".
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_words, ship, stored

#: Words that the exchange moves on one matrix, and classes (the end's own included; 125 at most).
FREQUENT, CLASSES = 1500, 48
#: Tokens of one chunk, about (a longer text is cut into chunks of its own), and bytes of its dictionary.
CHUNK_WORDS, CHUNK_BYTES = 1_500_000, 64_000_000
#: A word of more bytes isn't among the words that are broadcast.
LONGEST_FREQUENT = 64
END = b"\n"  # no word holds white space


def packed(tokens: np.ndarray) -> bytes:
    """Compressed indexes; the bytes of equal weight stand together, as most high ones are 0."""
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(tokens).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Frozen(NamedTuple):
    """What placing the other words needs; its size is fixed."""

    classes: dict[bytes, int]  # of the frequent words and the end
    gain: np.ndarray  # log of P(class | class before) to P(class), of the frequent words
    count: int  # of classes
    prior: np.ndarray  # decides between classes that gain the same


class Model(NamedTuple):
    """Everything that scoring needs beside the classes of tokens; its size is fixed."""

    tokens: int  # N
    transition: np.ndarray  # log10 P(class | class)
    emission: np.ndarray  # log10 of a class's share for known words, over its tokens
    unknown: np.ndarray  # log10 P(unknown word | class before)
    unknown_class: int  # what an unknown word is as history


def coded(df: DataFrame, id_col: str, text_col: str, learns: Column) -> DataFrame:
    """The chunks: words (distinct, the end first), trained (counts in documents that `learns`
    holds for), ids, learns and lengths of documents, their tokens, lead (the word before the first
    token: the end, or in a text cut into chunks the last one of the chunk before) and piece
    (which chunks are of one text; null for whole documents)."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), learns.alias("learns"))
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("trained", T.ArrayType(T.IntegerType())),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("learns", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("tokens", T.BinaryType()),
            T.StructField("lead", T.IntegerType()),
            T.StructField("piece", T.LongType()),
        ]
    )
    number = lambda: uuid.uuid4().int >> 65

    class Chunk:
        def __init__(self, lead: bytes = END, piece: int | None = None):
            self.place: dict[bytes, int] = {END: 0}
            self.lead, self.piece = self.index(lead), piece
            self.tokens, self.lengths, self.learns, self.ids = [], [], [], []
            self.held, self.bytes = 0, 0

        def index(self, w: bytes) -> int:
            return self.place.setdefault(w, len(self.place))

        def add(self, words: list[bytes], end: bool, learns: bool, one_id: pa.Array) -> None:
            place = self.place
            for w in words:
                if w not in place:
                    place[w] = len(place)
                    self.bytes += len(w)
            self.tokens.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
            if end:
                self.tokens.append(np.zeros(1, dtype=np.int32))
            self.lengths.append(len(words) + end)
            self.learns.append(learns)
            self.ids.append(one_id)
            self.held += len(words) + end

        def row(self) -> pa.RecordBatch:
            t = np.concatenate(self.tokens)
            trained = np.bincount(t[np.repeat(np.array(self.learns), self.lengths)], minlength=len(self.place))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            out = [pa.array([number()]), one(list(self.place), pa.binary()), one(trained.astype(np.int32), pa.int32())]
            out += [pa.ListArray.from_arrays(pa.array([0, len(self.lengths)], pa.int32()), pa.concat_arrays(self.ids)), one(self.learns, pa.bool_()), one(np.array(self.lengths, dtype=np.int32), pa.int32())]
            out += [pa.array([packed(t)]), pa.array([self.lead], pa.int32()), pa.array([self.piece], pa.int64())]
            return pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    def run(batches):
        chunk = Chunk()
        for batch in batches:
            texts, learn = batch.column(1), batch.column(2).to_pylist()
            for k in range(batch.num_rows):
                words, one_id = lower_words(texts[k].as_py()), batch.column(0).slice(k, 1)
                if len(words) < CHUNK_WORDS:
                    chunk.add(words, True, bool(learn[k]), one_id)
                else:
                    piece = number()
                    for i in range(0, len(words), CHUNK_WORDS):
                        part = Chunk(words[i - 1] if i else END, piece)
                        part.add(words[i : i + CHUNK_WORDS], i + CHUNK_WORDS >= len(words), bool(learn[k]), one_id)
                        yield part.row()
                if chunk.held >= CHUNK_WORDS or chunk.bytes >= CHUNK_BYTES:
                    yield chunk.row()
                    chunk = Chunk()
        if chunk.lengths:
            yield chunk.row()

    return rows.mapInArrow(run, schema)


def exchange(m: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of the units of the bigram count matrix m (before, after): each unit in turn goes
    to the class that raises the likelihood of the class bigram most, until none moves.
    Unit 0, the end of a text, stays alone in class 0."""
    n = len(m)
    m = m.astype(np.float64)
    size = m.sum(axis=0) + m.sum(axis=1)
    order = np.array([u for u in np.argsort(-size, kind="stable") if u != 0 and size[u] > 0])
    label = np.zeros(n, dtype=np.int64)
    if classes < 2 or not len(order):
        return label
    label[1:] = 1
    label[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[label]
    after, before = m @ member, m.T @ member  # of each unit, by class of the other word
    c = member.T @ after

    def g(x):
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = label[w], m[w, w]
            r, s = after[w].copy(), before[w].copy()
            c[a] -= r
            c[:, a] -= s
            c[a, a] += own
            r[a] -= own
            s[a] -= own
            base, first, second = g(c), c.sum(axis=1), c.sum(axis=0)
            rows, cols = g(c + r[None, :]) - base, g(c + s[:, None]) - base
            here = np.diag(c)
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + g(here + r + s + own) - g(here)
            gain -= g(first + r.sum() + own) - g(first) + g(second + s.sum() + own) - g(second)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            c[b] += r
            c[:, b] += s
            c[b, b] += own
            if b != a:
                moved += 1
                label[w] = b
                after[:, a] -= m[:, w]
                after[:, b] += m[:, w]
                before[:, a] -= m[w]
                before[:, b] += m[w]
        if not moved:
            break
    return label


def transitions(c: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """P(class | class) from class bigram counts: each row is interpolated with the frequencies
    of all classes, which weigh as `strength` observations."""
    total = c.sum(axis=0)
    share = total / max(total.sum(), 1.0)
    return (c + strength * share[None, :]) / (c.sum(axis=1, keepdims=True) + strength)


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log10(x)


def most_frequent(counts: DataFrame, limit: int) -> dict[bytes, int]:
    """The `limit` most frequent words (fewer if there are fewer), of equal ones those of the smallest
    CRC (words of one CRC at the limit stay out). Histograms find where the limit lies, by steps of the count (an eighth of
    an octave), then counts in the step at the limit, then slices of CRCs in the count at the limit: no
    sort and no top-k, which would merge every task's best in one."""
    counts = counts.where(F.octet_length("word") <= LONGEST_FREQUENT)
    levels = [("step", -F.floor(F.log2("n") * 8)), ("level", -F.col("n"))]
    levels += [(f"crc{width}", F.shiftright(F.crc32("word"), width)) for width in (20, 8, 0)]
    at, room, taken = F.lit(True), limit, []
    for name, level in levels:
        last = None
        for row in sorted(counts.where(at).groupBy(level.alias(name)).agg(F.count("*").alias("words")).collect()):
            if row.words > room:
                last = row[name]
                break
            room -= row.words
        if last is None:
            taken.append(at)
            break
        taken.append(at & (level < last))
        at = at & (level == last)
        if not room:
            break
    some = taken[0]
    for more in taken[1:]:
        some = some | more
    top = counts.where(some).toArrow()
    return dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))


def freeze(m: np.ndarray, words: list[bytes], classes: int) -> Frozen:
    """Classes of the frequent words from their bigram counts m (words[k] is unit k; unit 0 is the end)."""
    label = exchange(m, classes)
    member = np.eye(classes)[label]
    c = member.T @ m @ member
    share = c.sum(axis=0) / max(c.sum(), 1.0)
    gain = np.log(np.maximum(transitions(c), 1e-12)) - np.log(np.maximum(share, 1e-12))[None, :]
    return Frozen(dict(zip(words, label.tolist(), strict=True)), np.where(share[None, :] > 0, gain, 0.0), classes, 1e-6 * share)


def contexts(tokens: np.ndarray, trained: np.ndarray, known: np.ndarray, lead: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For the other words' trained tokens: the word, and the class of a neighbour (a class before, or
    `classes` more for one after); known: classes of a chunk's words, -1 for words to be placed."""
    of = known[tokens]
    at = np.flatnonzero((of < 0) & trained)
    before = np.concatenate([[known[lead]], of[:-1]])[at] if len(at) else at
    after = np.concatenate([of[1:], [-1]])[at] if len(at) else at
    word = np.concatenate([tokens[at][before >= 0], tokens[at][after >= 0]])
    return word, np.concatenate([before[before >= 0], after[after >= 0] + classes])


def placed(counts: np.ndarray, frozen: Frozen) -> np.ndarray:
    """The class of each word (row) by its counts of classes before and after: the one that gains most,
    and not the end's."""
    k = frozen.count
    if k < 2:
        return np.zeros(len(counts), dtype=np.int64)
    value = counts[:, :k] @ frozen.gain + counts[:, k:] @ frozen.gain.T + frozen.prior
    return 1 + np.argmax(value[:, 1:], axis=1)


def resolve(words: list[bytes], starts: np.ndarray, own: np.ndarray, around: list[bytes], frozen: Frozen) -> tuple[np.ndarray, np.ndarray]:
    """Counts over the corpus and classes of words from all their chunks' rows; words[k] has the rows
    from starts[k] on, own are their counts and around their neighbours' classes."""
    n = np.add.reduceat(own, starts) if len(own) else own
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(own)]))
    k = 2 * frozen.count
    codes = np.repeat(group, list(map(len, around))) * k + np.frombuffer(b"".join(around), dtype=np.uint8)
    label = placed(np.bincount(codes, minlength=len(starts) * k).reshape(-1, k).astype(np.float64), frozen)
    for i, w in enumerate(words):
        if (c := frozen.classes.get(w)) is not None:
            label[i] = c
    return n, label


def known_classes(words: list[bytes], frozen: Frozen) -> np.ndarray:
    get = frozen.classes.get
    return np.array([get(w, -1) for w in words], dtype=np.int64)


def learn(chunks: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES) -> tuple[int, int, Frozen]:
    """N, V (the end included) and the frozen classes."""
    if not 1 <= classes <= 125:
        raise ValueError("1 to 125 classes")
    pairs = chunks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.trained").cast("long").alias("n")).where("n > 0")
    counts = stored(pairs.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = most_frequent(counts.where(F.col("word") != F.lit(END)), frequent)
    words = [END, *sorted(common, key=lambda w: (-common[w], w))]
    spark = chunks.sparkSession
    units = spark.sparkContext.broadcast({w: k for k, w in enumerate(words)})  # `frequent` words of LONGEST_FREQUENT bytes at most
    size = len(words)

    def bigrams(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                unit = np.array([units.value.get(w, size) for w in batch.column(0)[k].as_py()], dtype=np.int64)
                learns, lengths = (batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i in (1, 2))
                u, of = unit[unpacked(batch.column(3)[k].as_py())], np.repeat(learns.astype(bool), lengths)
                before = np.concatenate([[unit[batch.column(4)[k].as_py()]], u[:-1]])[of]  # a text begins after the end of another
                u = u[of]
                both = (u < size) & (before < size)
                code, times = np.unique(before[both] * size + u[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "n"])

    found = chunks.select("words", "learns", "lengths", "tokens", "lead").mapInArrow(bigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # (frequent + 1) squared rows at most
    m = np.zeros(size * size, dtype=np.int64)
    m[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return int(n), int(v), freeze(m.reshape(size, size), words, classes)


def answers(chunks: DataFrame, frozen: Frozen) -> DataFrame:
    """(of, at, n, label, fixed): count and class of the word at `at` in the dictionary of chunk `of`, and
    whether it is one of the frequent words. A word that isn't frequent and that no other chunk was trained on has no row: the chunk knows both."""
    shared = chunks.sparkSession.sparkContext.broadcast(frozen)

    def entries(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, words, own, learns, lengths, raw, lead = (batch.column(i)[k] for i in range(7))
                known = known_classes(words.as_py(), shared.value)
                trained = np.repeat(learns.values.to_numpy(zero_copy_only=False).astype(bool), lengths.values.to_numpy())
                word, code = contexts(unpacked(raw.as_py()), trained, known, lead.as_py(), shared.value.count)
                order = np.argsort(word, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(known)))]).astype(np.int32)
                around = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(ends), pa.py_buffer(code[order].astype(np.uint8))])
                whole = [words.values, pa.array(np.full(len(known), chunk.as_py())), pa.array(np.arange(len(known), dtype=np.int32)), own.values, around]
                for i in range(0, len(known), 10_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 10_000) for x in whole], names=["word", "of", "at", "own", "around"])

    def merge(batches):
        def close(held):
            t = pa.Table.from_batches(held).combine_chunks()
            word = t.column("word").combine_chunks() if t.column("word").num_chunks != 1 else t.column("word").chunk(0)
            cuts = np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            own = t.column("own").to_numpy().astype(np.int64)
            words = word.take(pa.array(cuts)).to_pylist()
            n, label = resolve(words, cuts, own, t.column("around").to_pylist(), shared.value)
            fixed = np.array([w in shared.value.classes for w in words])
            rows = np.diff([*cuts, len(own)])
            n, label, fixed = (np.repeat(x, rows) for x in (n, label, fixed))
            pick = np.flatnonzero((n != own) | fixed)
            return pa.RecordBatch.from_arrays([pa.array(t.column("of").to_numpy()[pick]), pa.array(t.column("at").to_numpy()[pick]), pa.array(n[pick]), pa.array(label[pick].astype(np.int32)), pa.array(fixed[pick])], names=["of", "at", "n", "label", "fixed"])

        held: list[pa.RecordBatch] = []  # of one word, or closed
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            cuts = np.flatnonzero(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
            if held and held[-1].column(0)[0] != word[0]:
                yield close(held)
                held = []
            if len(cuts):
                yield close([*held, batch.slice(0, int(cuts[-1]) + 1)])
                held = []
                batch = batch.slice(int(cuts[-1]) + 1)
            held.append(batch)
        if held:
            yield close(held)

    rows = chunks.select("chunk", "words", "trained", "learns", "lengths", "tokens", "lead").mapInArrow(entries, "word binary, of long, at int, own int, around binary")
    # A word has a row for each chunk at most.
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(merge, "of long, at int, n long, label int, fixed boolean")


def classed(chunks: DataFrame, found: DataFrame, tokens: int, words: int, frozen: Frozen) -> DataFrame:
    """The chunks with the class of each token (the number of classes for unknown words), what can be
    summed by document (n_known, base, and logs: log10 of the known words' counts), and counts of
    class bigrams followed by counts of words seen once by class."""
    shared = chunks.sparkSession.sparkContext.broadcast(frozen)
    kind = chunks.schema["ids"].dataType
    schema = T.StructType(
        [
            T.StructField("ids", kind),
            T.StructField("learns", T.ArrayType(T.BooleanType())),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("n_known", T.ArrayType(T.LongType())),
            T.StructField("base", T.ArrayType(T.DoubleType())),
            T.StructField("logs", T.ArrayType(T.DoubleType())),
            T.StructField("classes", T.BinaryType()),
            T.StructField("lead", T.IntegerType()),
            T.StructField("piece", T.LongType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def run(one: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        k = shared.value.count
        for row in range(one.num_rows):  # a chunk has one row
            get = lambda c: one.column(c)[row]  # noqa: B023, E731
            own = get("trained").values.to_numpy().astype(np.int64)
            n, label, at = own.copy(), np.full(len(own), -1), found.column("at").to_numpy()
            n[at], label[at] = found.column("n").to_numpy(), found.column("label").to_numpy()
            known = np.full(len(own), -1)
            fixed = at[found.column("fixed").to_numpy(zero_copy_only=False)]
            known[fixed] = label[fixed]
            t, lengths, lead = unpacked(get("tokens").as_py()), get("lengths").values.to_numpy(), get("lead").as_py()
            trained = np.repeat(get("learns").values.to_numpy(zero_copy_only=False).astype(bool), lengths)
            left = np.flatnonzero((label < 0) & (own > 0))  # words of this chunk alone
            word, code = contexts(t, trained, known, lead, k)
            place = np.full(len(own), -1)
            place[left] = np.arange(len(left))
            mine = place[word] >= 0
            for i in range(0, len(left), 50_000):
                part = mine & (place[word] >= i) & (place[word] < i + 50_000)
                size = min(50_000, len(left) - i)
                around = np.bincount((place[word[part]] - i) * 2 * k + code[part], minlength=size * 2 * k).reshape(-1, 2 * k)
                label[left[i : i + size]] = placed(around.astype(np.float64), shared.value)
            label[n == 0] = k
            here = label[t]
            before = np.concatenate([[label[lead]], here[:-1]])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sums = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
            base = np.log10((n + 0.1) / (tokens + 0.1 * (words + 1)))
            bigrams = np.bincount(before[trained] * k + here[trained], minlength=k * k)
            once = np.bincount(label[(n == 1) & (own == 1)], minlength=k)
            many = lambda values, kind: pa.array([values], pa.list_(kind))
            out.append(
                pa.table(
                    [
                        one.column("ids").slice(row, 1),
                        one.column("learns").slice(row, 1),
                        one.column("lengths").slice(row, 1),
                        many(sums((n[t] > 0).astype(np.int64)), pa.int64()),
                        many(sums(base[t]), pa.float64()),
                        many(sums(np.log10(np.maximum(n, 1))[t]), pa.float64()),
                        pa.array([len(t).to_bytes(8, "little") + pa.compress(here.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                        pa.array([int(label[lead])], pa.int32()),
                        one.column("piece").slice(row, 1),
                        pa.array([np.concatenate([bigrams, once]).astype("<i8").tobytes()], pa.binary()),
                    ],
                    names=schema.fieldNames(),
                )
            )
        return pa.concat_tables(out)

    slim = chunks.select("chunk", "trained", "ids", "learns", "lengths", "tokens", "lead", "piece")
    return slim.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)


def model_of(c: np.ndarray, once: np.ndarray, tokens: int) -> Model:
    """From class bigrams (before, after) and words seen once by class."""
    total = c.sum(axis=0).astype(np.float64)
    unseen = np.clip(once / np.maximum(total, 1), 0, 0.5)
    p = transitions(c.astype(np.float64))
    return Model(tokens, _log(p), _log((1 - unseen) / np.maximum(total, 1)), _log(p @ unseen + 1e-12), int(np.argmax(once)))


def score(marked: DataFrame, model: Model, classes: int, id_col: str) -> DataFrame:
    shared = marked.sparkSession.sparkContext.broadcast(model)
    kind = marked.schema["ids"].dataType.elementType
    fields = [T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    fields += [T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField("piece", T.LongType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k]  # noqa: B023, E731
                raw = get("classes").as_py()
                here = np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), dtype=np.uint8).astype(np.int64)
                known = here < classes
                history = np.where(known, here, m.unknown_class)
                first = get("lead").as_py()
                before = np.concatenate([[first if first < classes else m.unknown_class], history[:-1]])
                p = np.where(known, m.transition[before, history] + m.emission[history], m.unknown[before])
                lengths = get("lengths").values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                held = ~get("learns").values.to_numpy(zero_copy_only=False).astype(bool)
                columns = [get("ids").values, pa.array(held), pa.array(lengths.astype(np.int64)), get("n_known").values, pa.array(np.full(len(lengths), m.tokens))]
                columns += [get("base").values, pa.array(np.add.reduceat(p, starts) + get("logs").values.to_numpy()), pa.array([get("piece").as_py()] * len(lengths), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    out = marked.select("ids", "learns", "lengths", "n_known", "base", "logs", "classes", "lead", "piece").mapInArrow(run, schema)
    whole = out.where("piece IS NULL").drop("piece")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.first("train_tokens").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score")]
    cut = out.where("piece IS NOT NULL").groupBy("piece").agg(F.first(id_col).alias(id_col), F.first("held_out").alias("held_out"), *sums)
    return whole.unionByName(cut.drop("piece"))


def held_out(id_col: Column, folds: int = 10) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id counts as an empty one."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == 0


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """One row for each row of df: id_col, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram, add 0.1) and score (class bigram), both log10 probabilities.

    Learns from the rows that aren't held out. A null or empty text is its end alone. Ids may
    be null or repeated; every row is scored by itself. Texts of over CHUNK_WORDS words are read in
    parts and summed. Other columns aren't read, so their names can't clash. An empty table gives an
    empty one; if no row is left to learn from, the base is uniform and the score of every text
    follows from nothing but unknown words.
    """
    chunks = stored(coded(df, id_col, text_col, ~held_out(F.col(id_col))), "chunks")
    tokens, words, frozen = learn(chunks, frequent, classes)
    marked = stored(classed(chunks, answers(chunks, frozen), tokens, words, frozen), "classed")
    size = classes * classes + classes

    def add_up(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = marked.select("counts").mapInArrow(add_up, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # `size` rows at most
    total = np.zeros(size, dtype=np.int64)
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    model = model_of(total[: classes * classes].reshape(classes, classes), total[classes * classes :], tokens)
    return score(marked, model, classes, id_col)
