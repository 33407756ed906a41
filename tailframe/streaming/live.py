"""Live measures over an event stream: an extension, there is no batch counterpart to match.

Windowed means are kept by Spark's own state store with a watermark; a stateful operator keeps
an exponentially weighted variance for each key; and foreachBatch recomputes batch measures on
the history that has arrived.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tailframe.operators import returns, tail, volatility
from tailframe.plans.shipping import ship


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, pattern: str = "*") -> DataFrame:
    """The files of a folder whose names match, some at a time."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def window_means(events: DataFrame, every: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Mean value by event type and tumbling (or sliding) window; rows later than `late` are dropped."""
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = events.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.avg("value").alias("close"), F.count("*").alias("volume"))
    return out.select(F.col("event_type").alias("series_id"), F.col("w.start").alias("d"), "close", F.col("close").alias("adj_close"), "volume")


def session_totals(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def weighted_variance(prices: DataFrame, decay: float = 0.94) -> DataFrame:
    """series_id, d, ewma_volatility for each arriving price. A key's state is three numbers; a price
    that is older than the last one of its key is skipped."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_ms, last_price, variance = state.get if state.exists else (-(2**62), math.nan, math.nan)
        rows = pd.concat(list(batches)).sort_values("d")
        out = []
        for d, p in zip(rows["d"], rows["close"], strict=True):
            ms = int(pd.Timestamp(d).value // 1_000_000)
            if ms <= last_ms or not p > 0:
                continue
            if last_price > 0:
                r = math.log(p / last_price)
                variance = r * r if math.isnan(variance) else decay * variance + (1 - decay) * r * r
                out.append((key[0], d, math.sqrt(variance)))
            last_ms, last_price = ms, float(p)
        state.update((last_ms, last_price, variance))
        yield pd.DataFrame(out, columns=["series_id", "d", "ewma_volatility"])

    ship(prices.sparkSession)
    return prices.groupBy("series_id").applyInPandasWithState(update, "series_id string, d timestamp, ewma_volatility double", "last_ms bigint, last_price double, variance double", "append", GroupStateTimeout.NoTimeout)


def history_measures(history: DataFrame, confidence: float = 0.95) -> DataFrame:
    r = returns.log_returns(history)
    v = volatility.historical_volatility(r).select("series_id", "daily", "n_observations")
    return v.join(tail.historical_var(r, confidence).select("series_id", "var_return"), "series_id")


def keep_history(table: str, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: stores each batch in a folder of its own, so that a batch that is run again
    replaces itself, and hands the measures of the whole history to `then`."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        then(history_measures(batch.sparkSession.read.parquet(table).drop("batch")), number)

    return run
