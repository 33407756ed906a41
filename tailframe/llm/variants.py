"""Spelling variants: groups of words that single edits connect to a more frequent one.

Two words are near if one insertion, deletion or replacement turns one into the other. That holds just if
the lengths of their common prefix and common suffix together reach the longer length minus one. So words
become rows of padded code-point matrices, once from the left and once from the right, and a pair of blocks
is compared at once: the first column in which two rows differ is the length of their prefix or suffix.

Of a near pair whose longer word has M letters, the prefix or the suffix has ceil((M - 1) / 2) at least. Words
meet in tiles by M and that many letters of either end; a tile is cut into blocks of bounded size and each
pair of blocks is a job of its own, however full the tile is. A job emits sums and the best near word for each
of its words, not pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, ship, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task counts before it hands its counts on.
HELD = 200_000
#: Words of a block, and letters up to which words of one matrix may be padded.
BLOCK = 384
#: Comparisons (pairs of words) that are in memory at once.
AT_ONCE = 1 << 16
#: Seats (words in tiles, four a word) of a task, about: few bytes, but much work.
SEATS_A_TASK = 50_000
#: A chain of forms rises in frequency by RATIO with every step, so 60 doublings reach any end.
ROUNDS = 60


def words_of(doc_id: int | None, text: str | None, every: int = 199, least: int = 6) -> Counter:
    """The words of a text that have `least` letters or more once the letters that the contract drops are gone.
    A null id counts as an empty one."""
    if not text:
        return Counter()
    lead, out = f"{'' if doc_id is None else doc_id}:".encode(), Counter()
    start = crc32(lead)
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        if len(run) >= least:
            h = crc32(run.encode("utf-8"), start)  # goes on from lead
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
                if len(run) < least:
                    continue
            out[run] += n
    return out


def count_words(df: DataFrame, least: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: of all words of at least `least` letters."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held.update(words_of(doc_id, text, every, least))
                    if len(held) >= HELD:
                        yield out()
        yield out()

    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left, code points from the right (both padded with 0), and lengths."""
    left = np.zeros((len(words), width), dtype=np.uint32)
    right = np.zeros_like(left)
    for k, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
        left[k, : len(points)] = points
        right[k, : len(points)] = points[::-1]
    return left, right, np.array([len(w) for w in words], dtype=np.int64)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading columns in which each row of a equals each row of b."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(axis=2)
    return np.where(differ.any(axis=2), first, a.shape[1])


def near(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether words of a and b are near, and the lengths of their common prefixes; a and b: matrices() of one
    width. Equal words aren't near."""
    lengths = np.minimum(a[2][:, None], b[2][None, :])
    longer = np.maximum(a[2][:, None], b[2][None, :])
    prefix = np.minimum(common(a[0], b[0]), lengths)
    suffix = np.minimum(common(a[1], b[1]), lengths)
    same = (prefix == longer) & (lengths == longer)
    return (longer - lengths <= 1) & (prefix + suffix >= longer - 1) & ~same, prefix


def compare(words: list[str], n: np.ndarray, left: np.ndarray, right: np.ndarray, longer: int, by_prefix: bool) -> dict[int, tuple[int, int, str]]:
    """left and right: indexes of the words of two blocks (the same array: one block with itself). For each index
    with a near word found here: how many, minus the best one's count, and the best one. Only pairs whose longer word
    has `longer` letters count, and of those in a tile by suffix only the pairs that don't meet by prefix."""
    own = left is right
    a = matrices([words[i] for i in left], longer)
    b = a if own else matrices([words[i] for i in right], longer)
    pairs = []
    step = max(1, AT_ONCE // max(1, len(right)))
    for k in range(0, len(left), step):
        part = tuple(x[k : k + step] for x in a)
        found, prefix = near(part, b)
        found &= np.maximum(part[2][:, None], b[2][None, :]) == longer
        if not by_prefix:
            found &= prefix < longer // 2
        rows, columns = np.nonzero(found)
        pairs += zip(left[k + rows].tolist(), right[columns].tolist(), strict=True)
    some: dict[int, tuple[int, int, str]] = {}
    for i, j in pairs if own else [*pairs, *((j, i) for i, j in pairs)]:
        seen, *top = some.get(i, (0, 0, ""))
        some[i] = (seen + 1, *min([tuple(top), (-int(n[j]), words[j])]))
    return some


def near_words(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """counts: word, n (a row a word). word, n_near, best (n, word) for the words with a near one."""
    ship(counts.sparkSession)
    length = F.length("word")
    meet = lambda longer: F.array(
        F.struct(longer.alias("longer"), F.lit(True).alias("by_prefix"), F.substring("word", F.lit(1), F.floor(longer / 2).cast("int")).alias("key")),
        F.struct(longer.alias("longer"), F.lit(False).alias("by_prefix"), F.substring("word", (length - F.floor(longer / 2) + 1).cast("int"), F.floor(longer / 2).cast("int")).alias("key")),
    )
    seats = counts.select("word", "n", F.explode(F.concat(meet(length), meet(length + 1))).alias("s")).select("word", "n", "s.*")
    # A tile without a word of its longer length, or with one word, has no pairs.
    tile = ["longer", "by_prefix", "key"]
    sizes = seats.groupBy(*tile).agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("longer")).alias("full")).where("size > 1 AND full > 0")
    blocks = stored(sizes.select(*tile, "size", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks")), "tiles")
    tagged = lambda df: df.withColumn("tile", F.concat_ws(":", "longer", "by_prefix", "key"))
    known = tagged(blocks)
    total = 4 * counts.count()
    seated = hot_join(tagged(seats), known.select("tile", "blocks"), "tile", known.select("tile", F.col("size").alias("n")), total, "word")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # Job (i, j), i <= j: block i with block j.
    jobs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, own).alias("i"), F.greatest(other, own).alias("j"), (own > other).alias("right")))
    tasks = seated.select("tile", "longer", "by_prefix", "word", "n", F.explode(jobs).alias("job")).select("tile", "job.i", "job.j", "longer", "by_prefix", "job.right", "word", "n")
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SEATS_A_TASK))
    tasks = tasks.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j")

    def job(rows: list[tuple]) -> list[tuple]:
        words, n = [r[6] for r in rows], np.array([r[7] for r in rows], dtype=np.int64)
        right = np.array([r[5] for r in rows], dtype=bool)
        if rows[0][1] == rows[0][2]:
            left = other = np.arange(len(rows))
        else:
            left, other = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(left) or not len(other) or len(rows) < 2:
            return []
        found = compare(words, n, left, other, rows[0][3], rows[0][4])
        return [(words[i], *x) for i, x in found.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != last:
                    if len(held) > 1:
                        out += job(held)
                    last, held = row[:3], []
                held.append(row)
            yield packed(out)
        yield packed(job(held) if len(held) > 1 else [])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["word", "n_near", "less", "best"])

    found = tasks.mapInArrow(run, "word string, n_near long, less long, best string")
    # The largest count, then the smallest word: the smallest of (-count, word).
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("top")).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def group_variants(df: DataFrame, least: int = 6, frequent: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each word of at least `least` letters that occurs at least `frequent` times: word, n, n_near
    (near words), form (the most frequent near word, of equal ones the smallest, if it is `ratio` times as
    frequent as the word; else null), form_n, and root (the word at the end of the chain of forms).

    Words are maximal runs of ASCII letters and the letters from U+00C0 to U+00FF (the two signs among
    them included), with A-Z alone lower-cased, less the letters dropped by words_of(). Null and empty texts have
    none; a null id counts as an empty one; repeated rows count again. Other columns aren't read, so their names
    can't clash. An empty table gives an empty one. Texts of any length are counted whole."""
    counts = stored(count_words(df, least, every, id_col, text_col).where(F.col("n") >= frequent), "words")
    met = near_words(counts, block)
    rises = F.col("best_n") >= ratio * F.col("n")
    words = counts.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(rises, F.col("best")).alias("form"), F.when(rises, F.col("best_n")).alias("form_n"))
    words = stored(words, "forms")

    # Chains: each round replaces the end reached by that end's own.
    ends = stored(words.where("form IS NOT NULL").select("word", F.col("form").alias("end")), "ends")
    for _ in range(ROUNDS):
        at = ends.groupBy("end").agg(F.count("*").alias("n"))
        onward = ends.select(F.col("word").alias("end"), F.col("end").alias("further"))
        moved = hot_join(ends, onward, "end", at, ends.count(), "word", "left")
        moved = stored(moved.select("word", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), "ends")
        if moved.where("moved").isEmpty():
            break
        ends = moved.select("word", "end")
    return words.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root"))


def oracle(least: int = 6, frequent: int = 5, ratio: int = 5, every: int = 199) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "list_reduce([x::BIGINT] || range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"""
WITH tab AS (SELECT list({step} ORDER BY x) AS t FROM range(256) r(x)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {least} GROUP BY 1, 2),
b AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM c),
h AS (SELECT id, run, n, xor(list_reduce([4294967295::BIGINT] || bytes, lambda s, v: xor(s // 256, t[xor(s % 256, v) + 1])), 4294967295::BIGINT) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % {every} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w GROUP BY 1 HAVING length(word) >= {least} AND sum(n) >= {frequent}),
del AS (SELECT word, n, length(word) AS l, i, substring(word, 1, i - 1) || substring(word, i + 1) AS d FROM v, lateral (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM del a JOIN v ON a.d = v.word UNION SELECT v.word, a.word, a.n FROM del a JOIN v ON a.d = v.word),
g AS (SELECT word, count(*) AS n_near, max(m) AS top FROM p GROUP BY 1),
f AS (SELECT g.word, min(near) AS form, top FROM g JOIN p ON p.word = g.word AND p.m = g.top GROUP BY g.word, top),
o AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN f.top >= {ratio} * v.n THEN form END AS form, CASE WHEN f.top >= {ratio} * v.n THEN f.top END AS form_n FROM v LEFT JOIN g USING (word) LEFT JOIN f USING (word)),
ch AS (WITH RECURSIVE ch AS (SELECT word, word AS reached FROM o UNION ALL SELECT ch.word, o.form FROM ch JOIN o ON ch.reached = o.word WHERE o.form IS NOT NULL) SELECT * FROM ch)
SELECT o.word, o.n, o.n_near, o.form, o.form_n, reached AS root FROM o JOIN ch USING (word) JOIN o e ON e.word = ch.reached WHERE e.form IS NULL
"""
