"""Mixing sources to target weights by nested hash-threshold histograms.

Built from DataFrame operations only. A document's place in its source is a hash of its id;
a source's share is taken up to a threshold of that hash. The threshold is found without a
sort: sizes are summed by (source, leading hash bits), the bucket in which the running sum
passes the budget is found, and only its rows are summed again by the next bits, until
the threshold is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

#: Bits of the hash in all, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of any characters but ASCII white space; 0 for null. Counts the places where a word
    ends, so no array of words is made."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def place(id_col: Column, seed: str) -> Column:
    """The first 60 bits of the MD5 of seed:id. Rows with equal ids share their place, and so
    their fate; a null id counts as an empty one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: int = 2) -> DataFrame:
    """sources: one row each with source and source_size. Adds target: factor times all sizes,
    shared by weight (in order of source by code point, null last, the weights repeating);
    a target stops at `most` times its source's size and the excess goes to the others by
    weight until none is above. That is the level at which water stands in vessels of
    these capacities and widths: vessels with the lowest capacity a width fill up first."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    order = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (order + 1).cast("int")).cast("double")
    s = sources.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = W.orderBy("full_at", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(factor)) - below) / F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """shares with base (copies that every document of the source has) and cut: documents whose
    place is below it have one copy more. The cut is after the last place at which the running
    sum is within the budget, or one place further if that comes nearer to it."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    todo = shares.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    found = stored(todo.select("source", "base", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before")), "mix-0")
    done = None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("r.prefix")
        rows = sized.alias("l").join(found.alias("r"), same & inside).select("l.source", "base", "budget", "before", F.shiftright("h", shift).alias("bucket"), "size")
        bars = rows.groupBy("source", "base", "budget", "before", "bucket").agg(F.sum("size").alias("size"))
        up_to = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("bucket"))
        over = bars.withColumn("up_to", up_to).where("up_to > budget")
        first = over.groupBy("source", "base", "budget").agg(F.min(F.struct("bucket", "up_to", "size")).alias("b"))
        # A source without such a bucket fits whole: no row, and no cut.
        found = stored(first.select("source", "base", "budget", F.col("b.bucket").alias("prefix"), (F.col("b.up_to") - F.col("b.size")).alias("before"), F.col("b.size").alias("bar")), f"mix-{shift}")
        done = found
    nearer = F.col("before") + F.col("bar") - F.col("budget") < F.col("budget") - F.col("before")
    cuts = done.select("source", (F.col("prefix") + nearer.cast("long")).alias("cut"))
    return todo.alias("l").join(cuts.alias("r"), same, "left").select("l.source", "source_size", "target", "base", F.coalesce("cut", F.lit(1 << HASH_BITS)).alias("cut"))


def _planned(own: DataFrame, weights, factor, most) -> DataFrame:
    """own: source, size and h of each row. The cuts by source, stored."""
    shares = stored(targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, most), "targets")
    return stored(thresholds(own, shares), "cuts")


def _copies() -> Column:
    return F.col("base") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    factor: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of df: id, source, size (words), source_size, target (words that the
    source shall give), copies (0 to most) and taken = copies * size.

    Only id, source and text are read, so other columns can't clash. Null texts have size 0;
    null is a source of its own, the last. Texts of size 0 are taken 0 words whatever their
    copies. Repeated ids fall on the same side of a threshold. Reruns agree, whatever the
    partitions. An empty table gives an empty one.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sized = stored(own.select("id", "source", word_count(F.col("text")).alias("size"), place(F.col("id"), seed).alias("h")), "sizes")
    cuts = _planned(sized, weights, factor, most)
    joined = sized.alias("l").join(cuts.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    return joined.select(F.col("id").alias(id_col), F.col("l.source").alias(source_col), "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of df as often as mix() takes it, with df's columns and no other.
    Rows aren't shuffled for it: a row's copies follow from its own id and its source's cut. Null texts
    have size 0, null is a source of its own, rows of one id share their fate, texts of any length are
    read whole, columns of any name stay as they are, and an empty table gives an empty one."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    keyed = row.withColumn("source", F.col(f"row.`{source_col}`").cast("string")).withColumn("h", place(F.col(f"row.`{id_col}`"), seed))
    sized = stored(keyed.select("source", word_count(F.col(f"row.`{text_col}`")).alias("size"), "h"), "sizes")
    cuts = _planned(sized, weights, factor, most)
    joined = keyed.alias("l").join(cuts.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select("row.*")


def oracle(seed: str = "mix") -> str:
    values = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
    return f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ({values})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w, (2 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS full_at FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at) * w) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
c AS (SELECT *, target - base * source_size AS budget FROM b),
g AS (SELECT source, h, sum(size) AS bar FROM sized GROUP BY source, h),
r AS (SELECT source, h, bar, sum(bar) OVER (PARTITION BY source ORDER BY h) AS up_to FROM g),
x AS (SELECT c.source AS source, min(h) AS h, arg_min(bar, h) AS bar, arg_min(up_to, h) AS up_to, any_value(budget) AS budget
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE up_to > budget GROUP BY c.source),
k AS (SELECT source, h + CASE WHEN up_to - budget < budget - (up_to - bar) THEN 1 ELSE 0 END AS cut FROM x)
SELECT doc_id, size, c.source_size, c.target, size * (base + CASE WHEN cut IS NULL OR sized.h < cut THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized JOIN c ON sized.source IS NOT DISTINCT FROM c.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM c.source
"""
