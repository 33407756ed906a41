"""Reproducible shuffling into shards by a Feistel permutation of global row numbers.

Every row gets a number from 0 to n - 1; a keyed permutation p of those numbers gives its
shard p mod k and its slot p div k. So shards differ by one row at most, slots have no gaps,
the same table and seed give the same order, and where a row went (or which row number stands
at a slot) is computed, not looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

ROUNDS = 8
#: Rows that one bucket of the numbering holds about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256
#: Numbers of equal rows that are listed at once.
RUN_ROWS = 10_000


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64 well mixed bits of x and key (the finishing steps of public splitmix64)."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of range(n): a Feistel network on the fewest bits that hold n,
    walked along its cycle until the value is below n again."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.low = np.uint64(bits // 2)
        self.low_mask = np.uint64((1 << (bits // 2)) - 1)
        self.high_mask = np.uint64((1 << (bits - bits // 2)) - 1)
        keys = np.arange(ROUNDS, dtype=np.uint64)
        self.keys = [int(k) for k in _mixed(keys, seed & (2**64 - 1))]

    def _rounds(self, x: np.ndarray, back: bool) -> np.ndarray:
        low, high = x & self.low_mask, x >> self.low
        for r in range(ROUNDS)[:: -1 if back else 1]:
            if r % 2:
                low = low ^ (_mixed(high, self.keys[r]) & self.low_mask)
            else:
                high = high ^ (_mixed(low, self.keys[r]) & self.high_mask)
        return (high << self.low) | low

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, dtype=np.uint64)
        if ((x >= self.n)).any():
            raise ValueError("a number is outside the range")
        out = self._rounds(x, back)
        while len(far := np.flatnonzero(out >= self.n)):  # ends: the cycle leads back to x at the latest
            out[far] = self._rounds(out[far], back)
        return out.astype(np.int64)

    def __call__(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, y) -> np.ndarray:
        return self._walk(y, True)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Rows (of the columns `order` alone) with row_number (0 to n - 1), and n. The number depends
    on the rows' values alone: groups of equal rows are dealt to buckets by a hash of them, ordered
    inside their bucket, and a bucket starts where the ones before it end. No row order of the
    input, and no sampled range, matters. Equal rows are interchangeable: they are counted before
    they are dealt and number themselves from where their group starts, in runs of RUN_ROWS."""
    groups = df.groupBy(*order).agg(F.count("*").alias("_rows"))
    n = df.count()
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))
    placed = groups.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = placed.groupBy("_bucket").agg(F.sum("_rows").alias("_rows"))
    starts = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    before = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = placed.withColumn("_inside", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(F.broadcast(starts), "_bucket").withColumn("_first", F.col("_start") + F.col("_inside"))
    last = F.col("_first") + F.col("_rows") - 1
    runs = first.withColumn("_from", F.explode(F.sequence(F.col("_first"), last, F.lit(RUN_ROWS))))
    runs = runs.select(*order, "_from", F.least(F.col("_from") + RUN_ROWS - 1, last).alias("_to"))
    return runs.select(*order, F.explode(F.sequence("_from", "_to")).alias("row_number")), n


def shard(df: DataFrame, shards: int = 8, seed: int = 20_240_607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, size (UTF-8 bytes of the text plus 1), text_crc32
    (unsigned), row_number, shard and slot.

    A null or empty text has no bytes: size 1 and the CRC of the empty string; texts of any length
    are read whole. Ids may be null or repeated: rows are ordered by id, CRC and size, and rows equal in all three differ in
    nothing that is returned. Only id and text are read, so other columns can't clash. An
    empty table gives an empty one.
    """
    ship(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(own, ["id", "text_crc32", "size"])

    def run(batches):
        permutation = Permutation(n, seed)
        for batch in batches:
            p = permutation(batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*batch.schema.names, "shard", "slot"])

    rows = rows.select("id", "size", "text_crc32", "row_number")
    out = rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))
    return out.withColumnRenamed("id", id_col)


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes one folder a shard, its rows in slot order in files that hold runs of slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
