"""Tables written between the steps of iterative plans."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master, where
    all is one machine, a temporary folder stands in for it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tailframe-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, is
    computed once, and survives the loss of any executor. It is deleted at the end of the scope that
    is open, unless there is none or it is to be kept."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tailframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted at the end. Results that are still to be computed from them have
    to be written (or stored to keep) before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


class Memo:
    """Stored tables by key, for `seconds` each: loads, fits and backtests that several views ask for are
    computed once, and an older one is computed anew and its table deleted."""

    def __init__(self, spark: SparkSession, seconds: float = 900):
        self.spark, self.seconds = spark, seconds
        self.held: dict[tuple, tuple[float, DataFrame, list[str]]] = {}

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        now = time.monotonic()
        known = self.held.get(key)
        if known is not None and now - known[0] <= self.seconds:
            return known[1]
        self.forget(key)
        with scope(self.spark):
            df = stored(make(), "memo", keep=True)
        self.held[key] = (now, df, [f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]])
        return df

    def forget(self, key: tuple) -> None:
        for path in self.held.pop(key, (0, None, []))[2]:
            delete(self.spark, path)

    def clear(self) -> None:
        for key in list(self.held):
            self.forget(key)
