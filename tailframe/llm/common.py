"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailframe.plans.shipping import ship
from tailframe.plans.storage import stored

#: Words are runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"

# bytes.lower() and bytes.split() change and split at exactly the ASCII letters and
# the six ASCII white space characters, so lower_words() equals WORD on UTF-8.

__all__ = ["WORD", "hot_join", "lower_words", "map_texts", "read_table", "ship", "stored"]

#: A key of more rows than this is hot; the threshold rises with the table so that no more than
#: MOST_HOT keys are, and they (a key and a number each) can be broadcast.
HOT_ROWS, MOST_HOT = 1000, 20_000


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    inputs: list[str],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    rows: int = 512,
) -> DataFrame:
    """Adds columns computed in Python from the columns `inputs`, batch by batch.

    make() is called once a task and gives the function from the input columns (Arrow
    arrays) to the arrays of the new columns. keep: the columns to carry over (all
    by default); one whose name clashes with a new field (in any case) is replaced.
    rows: rows that are held as Python objects at once.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    needed = list(dict.fromkeys([*carried, *inputs]))
    schema = T.StructType([df.schema[c] for c in carried] + fields)
    n_carried = len(carried)
    at = [needed.index(c) for c in inputs]
    names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                batch = whole.slice(i, rows)
                out = function([batch.column(k) for k in at])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], *out], names=names)

    return df.select(*(F.col(f"`{c}`") for c in needed)).mapInArrow(run, schema)


def hot_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, rows: int, by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, so that a key of many left rows is spread.

    sizes: (key, n), the left rows of each key; rows: their sum, about. A hot key's left rows are dealt
    by a hash of the column `by` into parts that the threshold bounds, and its right row gets a copy
    for each part.
    """
    least = max(HOT_ROWS, rows // MOST_HOT)
    hot = sizes.where(F.col("n") > least).select(F.col(key).alias("_key"), F.ceil(F.col("n") / F.lit(least)).cast("int").alias("_parts"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    one = left.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_key", "_parts")
    each = right.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_key", "_parts")
    return one.join(each, [key, "_part"], how).drop("_part")
