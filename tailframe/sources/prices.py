"""Price tables: readers, the file cache, the vendor data source, quality and cleaning."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tailframe.functions.columns import cache_safe, dbl, freshness, messages
from tailframe.plans import settings as S

SCHEMA = "series_id string, d date, close double, adj_close double, volume bigint, ingest_seq bigint"


def read_prices(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Prices in any format Spark reads (parquet, orc, csv, json, avro...). A missing adj_close is
    the close; a missing ingest_seq falls back to no order of arrival (0)."""
    reader = spark.read.format(kind).options(**options)
    if kind in ("csv", "json"):
        reader = reader.schema(SCHEMA)
    return normalised(reader.load(path))


def normalised(df: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in df.columns}
    named = {"adj close": "adj_close", "date": "d", "ticker": "series_id"}
    for old, new in named.items():
        if old in have and new not in have:
            df = df.withColumnRenamed(have[old], new)
            have[new] = new
    pick = lambda c, other: F.col(have[c]) if c in have else other
    close = F.col(have["close"]).cast("double")
    adjusted = pick("adj_close", close).cast("double")  # the close stands in for an absent column, not for a null
    return df.select(
        F.col(have["series_id"]).cast("string").alias("series_id"),
        F.col(have["d"]).cast("date").alias("d"),
        close.alias("close"),
        adjusted.alias("adj_close"),
        pick("volume", F.lit(None)).cast("bigint").alias("volume"),
        pick("ingest_seq", F.lit(0)).cast("bigint").alias("ingest_seq"),
    )


# --- The cache: one folder a period and series ------------------------------------------------


def benchmark_series(name: str) -> str:
    """The series of a benchmark's name; a series' own name stays."""
    return S.BENCHMARKS.get(name, name)


def cache_name(series: str) -> str:
    return series.translate(str.maketrans("^/", "__"))


def write_cache(prices: DataFrame, root: str, period: str, fetched_at: Column | None = None) -> None:
    """Overwrites the cached series of this period that `prices` holds, and no others."""
    out = prices.withColumn("fetched_at", fetched_at if fetched_at is not None else F.current_timestamp())
    out = out.withColumn("period", F.lit(period)).withColumn("cache", cache_safe("series_id"))
    out.repartition("cache").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "cache").parquet(root)


def read_cache(spark: SparkSession, root: str, period: str, series: list[str] | None = None) -> DataFrame:
    """Cached prices with fetched_at; the filters prune folders."""
    out = spark.read.parquet(root).where(F.col("period") == period)
    if series is not None:
        out = out.where(F.col("cache").isin([cache_name(s) for s in series]))
    return out.drop("period", "cache")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """Prices from files of one series each, named prices_<series>_<period>.json, that hold fetched_at and,
    as a string, a table split into columns, index and data. A file is read whole by one task; the
    series is named as in the file's name, and period and fetched_at come along. Files without a
    readable table give no rows."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    envelope = F.from_json("value", "fetched_at string, data string")
    table = F.from_json(F.col("e.data"), "columns array<string>, index array<string>, data array<array<double>>")
    named = r"^prices_(.*)_([^_]*)\.json$"
    out = files.select(F.regexp_extract("file", named, 1).alias("series_id"), F.regexp_extract("file", named, 2).alias("period"), envelope.alias("e")).withColumn("t", table)
    out = out.select("series_id", "period", F.to_timestamp("e.fetched_at").alias("fetched_at"), F.col("t.columns").alias("names"), F.col("t.data").alias("data"), F.posexplode("t.index").alias("k", "day"))
    value = lambda c: F.try_element_at(F.map_from_arrays("names", F.col("data")[F.col("k")]), F.lit(c))
    return out.select("series_id", F.to_date(F.substring("day", 1, 10)).alias("d"), value("close").alias("close"), value("adj_close").alias("adj_close"), value("volume").cast("bigint").alias("volume"), F.col("k").cast("bigint").alias("ingest_seq"), "period", "fetched_at")


def status(cached: DataFrame, now: Column) -> DataFrame:
    """Of each series: the last day, when it was fetched, its age and whether that is stale."""
    out = cached.groupBy("series_id").agg(F.max("d").alias("as_of"), F.max("fetched_at").alias("fetched_at"))
    age = (F.unix_micros(now) - F.unix_micros("fetched_at")) / dbl(60e6)
    return out.withColumn("age_minutes", age).withColumn("freshness", freshness("fetched_at", now))


class VendorReader(DataSourceReader):
    def __init__(self, tickers: list[str], fetch: Callable[[str, str], list[tuple]], period: str):
        self.tickers, self.fetch, self.period = tickers, fetch, period

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.tickers]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = self.fetch(partition.value, self.period)
        if not rows:
            raise ValueError(f"no prices for {partition.value}")
        for k, (day, close, adjusted, volume) in enumerate(rows):
            yield partition.value, day, close, close if adjusted is None else adjusted, volume, k


def vendor(name: str, fetch: Callable[[str, str], list[tuple]]) -> type[DataSource]:
    """A data source that calls fetch(ticker, period) -> [(day, close, adj_close or None, volume)],
    one task a ticker. Register it with spark.dataSource.register; the option tickers is a list
    with commas."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: T.StructType) -> VendorReader:
            tickers = [t.strip() for t in self.options["tickers"].split(",") if t.strip()]
            return VendorReader(tickers, fetch, self.options.get("period", "3y"))

    return Vendor


# --- Quality and cleaning ------------------------------------------------------------------


def _now(now: dt.datetime | Column | None) -> Column:
    return F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)


def last_arrivals(prices: DataFrame) -> DataFrame:
    """One row a series and day, the one that arrived last."""
    return _last_of_days(prices).select(*prices.columns)


def _last_of_days(prices: DataFrame) -> DataFrame:
    """last_arrivals() with _arrived, the rows of the day. Days are reduced by partial aggregates before anything is
    shuffled, so a series of many arrivals a day brings one row a day to the windows that follow."""
    keys, seq = ["series_id", "d"], "ingest_seq"
    others = [c for c in prices.columns if c not in (*keys, seq)]
    # A missing number is before all others; max_by() alone would leave its row out.
    order = F.struct(F.col(seq).isNotNull().alias("known"), F.col(seq).alias("at")) if dict(prices.dtypes)[seq] != "bigint" else F.coalesce(F.col(seq), F.lit(-(2**63)))
    last = prices.groupBy(*keys).agg(*(F.max_by(c, order).alias(c) for c in others), F.max(seq).alias(seq), F.count("*").alias("_arrived"))
    return last.select(*prices.columns, "_arrived")


def clean_prices(prices: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """Last arrivals up to now with a positive close. adj_close isn't looked at."""
    return last_arrivals(prices).where((F.col("d").cast("timestamp") <= _now(now)) & (F.col("close") > 0) & ~F.isnan("close"))


def _marked(prices: DataFrame, now: dt.datetime | Column | None) -> DataFrame:
    """The last arrival of each day with what validation has to know of it: arrivals, future, out of order, kept, gap,
    good price, move. All windows are by series, after one shuffle."""
    p = _last_of_days(prices).repartition("series_id")  # one shuffle for all windows
    p = p.withColumn("_future", F.col("d").cast("timestamp") > _now(now))
    p = p.withColumn("_back", F.col("d") < F.lag("d").over(W.partitionBy("series_id").orderBy("ingest_seq")))
    # Partitions by a flag keep the rows without it out of every lag.
    p = p.withColumn("_in", ~F.col("_future"))
    p = p.withColumn("_gap", F.datediff("d", F.lag("d").over(W.partitionBy("series_id", "_in").orderBy("d"))))
    p = p.withColumn("_good", F.col("_in") & F.coalesce((F.col("close") > 0) & ~F.isnan("close"), F.lit(False)))
    before = F.lag("close").over(W.partitionBy("series_id", "_good").orderBy("d"))
    return p.withColumn("_move", F.col("close") / F.nullif(before, dbl(0)) - 1)


def quality_report(prices: DataFrame, now: dt.datetime | Column | None = None, series: DataFrame | None = None) -> DataFrame:
    """One row a series of what validation finds; blocking findings make it unusable. Each check sees
    the rows that the ones before it left: duplicates, order, future, weekends, gaps, bad prices,
    extreme moves, spacing and length. series: a list (series_id) whose absent members are reported."""
    p = _marked(prices, now)
    inside, good = F.col("_in"), F.col("_good")
    gap = F.when(inside, F.col("_gap"))
    extreme = good & (F.abs("_move") > S.EXTREME_MOVE)
    p = p.withColumn("_nth", F.count_if(extreme).over(W.partitionBy("series_id", "_good").orderBy("d")))
    out = p.groupBy("series_id").agg(
        F.sum(F.col("_arrived") - 1).alias("n_duplicates"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("is_unordered"),
        F.count_if("_future").alias("n_future"),
        F.count_if(inside & F.dayofweek("d").isin(1, 7)).alias("n_weekend"),
        F.count_if(gap > S.GAP_DAYS).alias("n_large_gaps"),
        F.max(F.when(gap > S.GAP_DAYS, gap)).alias("max_gap_days"),
        F.count_if(inside & ~good).alias("n_bad_prices"),
        F.count_if(extreme).alias("n_extreme"),
        F.array_sort(F.collect_list(F.when(extreme & (F.col("_nth") <= 5), F.col("d")))).alias("extreme_dates"),
        F.percentile(gap, dbl(0.5)).alias("typical_gap"),
        F.count_if(good).alias("n_observations"),
        F.min(F.when(good, F.col("d"))).alias("first_day"),
        F.max(F.when(good, F.col("d"))).alias("last_day"),
    )
    if series is not None:
        counts = [c for c, t in out.dtypes if t == "bigint"]
        out = series.select("series_id").distinct().join(out, "series_id", "left").fillna(0, counts).fillna(False, ["is_unordered"])
    n = lambda c, text: (F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    none = F.col("first_day").isNull() & (F.col("n_bad_prices") + F.col("n_future") == 0)
    out = out.withColumn("issues", messages((none, "no data"), n("n_duplicates", " duplicate dates"), (F.col("is_unordered"), "dates out of order"), n("n_future", " future rows"), n("n_bad_prices", " bad prices")))
    out = out.withColumn("warnings", messages(n("n_weekend", " weekend rows"), n("n_large_gaps", " large gaps"), n("n_extreme", " extreme moves")))
    out = out.withColumn("blocking", messages((none, "no data"), (F.col("typical_gap") > S.SPARSE_GAP_DAYS, "too sparse"), (~none & (F.col("n_observations") < S.MIN_OBSERVATIONS), "too few observations")))
    return out.withColumn("usable", F.size("blocking") == 0)


def validated(prices: DataFrame, now: dt.datetime | Column | None = None, strict: bool = True) -> DataFrame:
    """clean_prices() of the series without a blocking finding, in the pass that finds them: one scan and one shuffle
    by series, no join with a report. strict: a blocking finding stops the job with its reasons; else such series
    are left out. A series without any good row has none to refuse."""
    of_series = W.partitionBy("series_id")
    p = _marked(prices, now)
    p = p.withColumn("_typical", F.percentile(F.when(F.col("_in"), F.col("_gap")), dbl(0.5)).over(of_series))
    p = p.withColumn("_n", F.count_if(F.col("_good")).over(of_series)).where("_good")
    blocking = messages((F.col("_typical") > S.SPARSE_GAP_DAYS, "too sparse"), (F.col("_n") < S.MIN_OBSERVATIONS, "too few observations"))
    p = p.withColumn("_blocking", blocking)
    usable = F.size("_blocking") == 0
    if strict:
        why = F.concat(F.col("series_id"), F.lit(": "), F.array_join("_blocking", "; "))
        p = p.where(F.when(usable, F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
    else:
        p = p.where(usable)
    return p.select(*prices.columns)


def load_and_validate(spark: SparkSession, path: str, kind: str = "parquet", now: dt.datetime | Column | None = None, strict: bool = True) -> DataFrame:
    """validated() prices of a path."""
    return validated(read_prices(spark, path, kind), now, strict)
