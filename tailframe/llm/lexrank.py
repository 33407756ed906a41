"""Ranked lexical search by dense products of term weights and term impacts.

All items are scored against all documents. A first pass turns each document into its number of terms
and the counts of those terms that some item uses; document frequencies are counted from that table. In
the second pass a tile is a block of items with a compact vocabulary of its own (only its items' terms):

    weights (items x vocabulary)  times  impacts (vocabulary x documents)

is a product of float64 matrices. Weights and impacts are integers, so a product is exact as long as no partial
sum reaches 2^53: the vocabulary is cut where a bound on the partial sums would, and the parts are added as
64-bit integers. Each tile of documents keeps, for each item, all documents whose score reaches the tile's
k-th best, ties included, before the exact order (score, then id) decides.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, ship, stored

#: Terms are runs of bytes beyond ASCII and of ASCII letters and digits; A-Z are lower-cased.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Terms (with repeats) of a group of items: each group is collected and broadcast, and is a pass over the documents.
GROUP_TERMS = 2_000_000
#: Items of a tile, terms of one product, documents of a tile.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 4096, 1024
#: Below this, sums of integers in float64 are exact.
EXACT = float(2**53)
#: No impact is above this: (10^9 tf) div (1000 tf + 8 m).
MOST_IMPACT = 1_000_000
#: Parts in which a task's best rows are merged before one task merges an item's.
MERGE_PARTS = 64


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order; bytes, as a set or a dictionary holds them."""
    return text.encode("utf-8", "surrogatepass").translate(SPLIT).split() if text else []


@dataclass
class Tile:
    """Some items: their positions in the group, the terms they use (as numbers in the group's vocabulary, rising),
    and how often each item has each (items x terms)."""

    items: np.ndarray
    vocabulary: np.ndarray
    counts: np.ndarray


def tiles(items: list[list[int]]) -> list[Tile]:
    """items: the term numbers of each item, with repeats."""
    out = []
    for i in range(0, len(items), TILE_ITEMS):
        some = items[i : i + TILE_ITEMS]
        vocabulary = np.unique(np.array([t for x in some for t in x], dtype=np.int64))
        counts = np.zeros((len(some), len(vocabulary)))
        for k, x in enumerate(some):
            np.add.at(counts[k], np.searchsorted(vocabulary, x), 1.0)
        out.append(Tile(np.arange(i, i + len(some)), vocabulary, counts))
    return out


def cuts(weights: np.ndarray, most: float = EXACT) -> list[slice]:
    """Ranges of the columns of weights (items x terms) whose largest possible partial sums stay below `most`, and
    that have TILE_TERMS columns at most. A range of one column may not, and is multiplied as integers."""
    out, start = [], 0
    bound = np.zeros(len(weights))
    for j in range(weights.shape[1]):
        more = bound + weights[:, j] * MOST_IMPACT
        if j > start and (j - start >= TILE_TERMS or more.max(initial=0.0) >= most):
            out.append(slice(start, j))
            start, more = j, weights[:, j] * MOST_IMPACT
        bound = more
    return [*out, slice(start, weights.shape[1])] if weights.shape[1] else []


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best: highest score above 0, then smallest id. All that tie with the k-th take part."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        edge = np.partition(scores[some], len(some) - k)[len(some) - k]
        some = some[scores[some] >= edge]
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Search:
    """Runs over batches of documents (id, n, term numbers, counts) and holds each item's k best."""

    def __init__(self, groups: list[Tile], weight: np.ndarray, size: int, documents: int, length: int, k: int):
        self.size, self.documents, self.length, self.k = size, documents, length, k
        self.tiles = [(t, t.counts * weight[t.vocabulary]) for t in groups]
        self.cuts = [cuts(w) for _, w in self.tiles]
        n = sum(len(t.items) for t, _ in self.tiles)
        self.ids, self.scores = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def impacts(self, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document (position in the tile) and the impact of each entry."""
        doc = np.repeat(np.arange(len(n)), np.diff(starts))
        m = 25 + (75 * n * self.documents) // max(self.length, 1)
        return doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])

    def add(self, ids: np.ndarray, n: np.ndarray, starts: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        doc, impact = self.impacts(n, starts, term, tf)
        for (tile, weights), ranges in zip(self.tiles, self.cuts, strict=True):
            at = np.searchsorted(tile.vocabulary, term)
            inside = at < len(tile.vocabulary)
            inside[inside] = tile.vocabulary[at[inside]] == term[inside]
            where, who, what = at[inside], doc[inside], impact[inside]
            scores = np.zeros((len(tile.items), len(ids)), dtype=np.int64)
            for r in ranges:
                some = (where >= r.start) & (where < r.stop)
                dense = np.zeros((r.stop - r.start, len(ids)))
                dense[where[some] - r.start, who[some]] = what[some]
                if r.stop - r.start > 1:
                    scores += (weights[:, r] @ dense).astype(np.int64)
                else:
                    scores += weights[:, r].astype(np.int64) * dense.astype(np.int64)
            for i, row in zip(tile.items, scores, strict=True):
                new = best(row, ids, self.k)
                if len(new):
                    both_ids, both = np.concatenate([self.ids[i], ids[new]]), np.concatenate([self.scores[i], row[new]])
                    keep = best(both, both_ids, self.k)
                    self.ids[i], self.scores[i] = both_ids[keep], both[keep]


def _vectors(df: DataFrame, numbers, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the text), term and tf (numbers and counts of the terms that items use, by number)."""

    def make():
        known = numbers.value

        def run(cols):
            n, term, tf, ends = [], [], [], [0]
            for text in cols[0].to_pylist():
                found = terms(text)
                counted = Counter(found)
                held = sorted((known[w], c) for w, c in counted.items() if w in known) if len(counted) < len(known) else sorted((k, counted[w]) for w, k in known.items() if w in counted)
                n.append(len(found))
                term += [t for t, _ in held]
                tf += [c for _, c in held]
                ends.append(len(term))
            offsets = pa.array(ends, pa.int32())
            return [pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))]

        return run

    fields = [T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))]
    own = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(own, make, ["text"], fields, ["id"])


def _groups(items: DataFrame) -> DataFrame:
    """items with a column g: groups whose terms are GROUP_TERMS at most, unless a single item has more."""
    sized = stored(items, "items")
    parts = 1
    while True:
        g = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
        over = sized.groupBy(g.alias("g")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > GROUP_TERMS) & (F.col("n") > 1))
        if over.isEmpty():
            return sized.withColumn("g", g)
        parts *= 2


def search(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_col, rank (from 1), id_col, score.

    Scores above 0 only, so an item may have fewer than k rows or none. Equal scores go by ascending id; null ids
    come last. Repeated rows of documents are documents of their own, and repeated items are items of their own. A
    null text has no terms. Other columns aren't read, so their names can't clash. An empty table on either side
    gives an empty result. Texts of any length are counted whole. The items are gone through in groups of bounded
    size, each a pass over the table of counts."""
    spark = documents.sparkSession
    ship(spark)
    make = lambda: lambda cols: [pa.array([len(terms(x)) for x in cols[0].to_pylist()], pa.int64())]
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{query_col}`").alias("query"))
    asked = map_texts(asked, make, ["query"], [T.StructField("size", T.LongType())]).where("size > 0").withColumn("row", F.monotonically_increasing_id())
    asked = _groups(asked)
    kind = items.schema[item_col].dataType
    results = [_search_group(spark, documents, asked.where(F.col("g") == r.g), k, id_col, text_col, kind) for r in asked.select("g").distinct().orderBy("g").collect()]
    if not results:
        return spark.createDataFrame([], T.StructType([T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())]))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_group(spark: SparkSession, documents: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, kind: T.DataType) -> DataFrame:
    group = asked.select("item", "query").toArrow()  # GROUP_TERMS terms at most
    names = group.column("item").combine_chunks()
    words = [terms(x) for x in group.column("query").to_pylist()]
    vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    vectors = stored(_vectors(documents, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    frequency = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the group
        frequency[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.float64)
    made = tiles([[vocabulary[w] for w in x] for x in words])
    shared = spark.sparkContext.broadcast((made, weight, len(vocabulary), total.n, total.l))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(*shared.value, k)
        for whole in batches:
            for i in range(0, whole.num_rows, TILE_DOCS):
                batch = whole.slice(i, TILE_DOCS)
                term, tf = batch.column(2), batch.column(3)
                ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                starts = term.offsets.to_numpy() - term.offsets[0].as_py()
                found.add(ids, batch.column(1).to_numpy(), starts, term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
        rows = [(i, d, s) for i in range(len(names)) for d, s in zip(found.ids[i].tolist(), found.scores[i].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["no", "id", "score"])

    tops = vectors.select("id", "n", "term", "tf").mapInArrow(run, "no int, id long, score long")
    tops = tops.withColumn("id", F.nullif("id", F.lit(np.iinfo(np.int64).max)))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = tops.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("no", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(*order))).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names.to_pylist())), T.StructType([T.StructField("no", T.IntegerType()), T.StructField("item", kind)]))
    return last.join(F.broadcast(named), "no").select("item", "rank", "id", "score")


def oracle(k: int = 10) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = r"regexp_extract_all(translate(text, '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (upper, lower)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, {words} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM t),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({words}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2, 3),
e AS (SELECT k, doc_id, len, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
f AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM e, s GROUP BY 1),
x AS (SELECT k, doc_id, e.term, f.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * s.n) // s.l))) AS v FROM e JOIN f USING (term), s),
r AS (SELECT i, item_id, k, doc_id, sum(c * v)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {k}
"""
