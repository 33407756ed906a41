"""Price panels derived from star-schema tables, for data without market prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _panel(df: DataFrame, series, day, value) -> DataFrame:
    """One pass with partial sums; only the columns used are scanned."""
    out = df.groupBy(series.alias("series_id"), day.cast("date").alias("d")).agg(F.avg(value).alias("close"), F.count("*").alias("volume"))
    return out.select("series_id", "d", "close", F.col("close").alias("adj_close"), "volume")


def line_prices(spark: SparkSession, folder: str) -> DataFrame:
    df = _read(spark, folder, "lineitem")
    return _panel(df, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"))


def benchmark_prices(spark: SparkSession, folder: str) -> DataFrame:
    df = _read(spark, folder, "lineitem")
    return _panel(df, F.lit("ALL"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"))


def order_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(_read(spark, folder, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def supplier_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Many series: one a supplier, of its prices by day of shipping. A supplier has about a line a day, so partial
    sums save nothing: lines are dealt by supplier once, which also serves the windows by series that follow. The
    number of parts is given, so that they aren't merged into few large ones."""
    df = _read(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), "l_shipdate", "l_extendedprice", "l_quantity")
    df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series_id")
    return _panel(df, F.col("series_id"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"))


def supplier_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """One series a supplier, by quarter, so that many of them have days in common."""
    df = _read(spark, folder, "lineitem")
    return _panel(df, F.col("l_suppkey").cast("string"), F.date_trunc("quarter", "l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"))


def nation_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for annual ratios: statistics of a nation's orders, scaled to the usual ranges."""
    orders, customer = _read(spark, folder, "orders"), _read(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    p = F.col("o_totalprice")
    stats = joined.groupBy(F.col("c_nationkey").cast("string").alias("entity"), F.year("o_orderdate").alias("fiscal_year")).agg(F.avg(p).alias("m"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    return stats.select(
        "entity",
        "fiscal_year",
        F.when(F.col("n") % 5 != 0, F.col("m") / F.col("lo") / 10).alias("interest_coverage"),
        (F.col("hi") / F.col("m")).alias("debt_to_equity"),
        (F.col("m") / 100000).alias("current_ratio"),
        F.when(F.col("n") % 7 != 0, f / n * 2).alias("cfo_to_net_income"),
        (f / n / 4 - 0.1).alias("fcf_margin"),
        (F.col("m") / F.col("hi")).alias("ebitda_margin"),
    )


def supplier_valuations(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for inputs of a discounted cash flow, one row a supplier."""
    s = _read(spark, folder, "supplier")
    k = F.col("s_suppkey")
    base = F.lit(100.0) + (k % 17)
    return s.select(
        k.cast("string").alias("entity"),
        F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: base * (F.lit(1.0) + i.cast("double") * 0.03)).alias("fcff"),
        (F.col("s_acctbal") / 20).alias("net_debt"),
        F.lit(50.0).alias("shares"),
        (F.lit(20.0) + (k % 30)).cast("double").alias("share_price"),
        (F.lit(0.08) + (k % 5) * F.lit(0.005)).alias("wacc"),
        (F.lit(0.02) + (k % 3) * F.lit(0.005)).alias("terminal_growth"),
    )
