import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tailframe.sources import prices as sources

from .helpers import business_days, one, prices

NOW = dt.datetime(2024, 6, 1)


def rows(spark, *extra, n=60, start="2024-01-01"):
    base = [("A", d, 100.0 + k % 3, 100.0, 1, k) for k, d in enumerate(business_days(n, start))]
    return spark.createDataFrame([*base, *extra], sources.SCHEMA)


def report(df, **more):
    return one(sources.quality_report(df, NOW, **more), series_id="A")


def test_clean_data_pass(spark):
    r = report(rows(spark))
    assert (r.issues, r.warnings, r.blocking, r.usable, r.n_observations) == ([], [], [], True, 60)


def test_last_arrival_wins(spark):
    df = rows(spark, ("A", dt.date(2024, 1, 1), 50.0, 50.0, 1, 500))
    r = report(df)
    assert (r.n_duplicates, r.is_unordered) == (1, True)
    assert one(sources.clean_prices(df, NOW).where("d = '2024-01-01'")).close == 50.0


def test_each_defect(spark):
    assert report(rows(spark, ("A", dt.date(2024, 8, 1), 1.0, 1.0, 1, 900))).n_future == 1
    assert report(rows(spark, ("A", dt.date(2024, 1, 6), 100.0, 100.0, 1, 900))).n_weekend == 1
    r = report(rows(spark, ("A", dt.date(2024, 4, 30), 100.0, 100.0, 1, 900)))
    assert (r.n_large_gaps, r.max_gap_days) == (1, 39)
    for bad in (0.0, -5.0, None, float("nan")):
        r = report(rows(spark, ("A", dt.date(2024, 3, 25), bad, 1.0, 1, 900)))
        assert (r.n_bad_prices, r.n_observations) == (1, 60)
    r = report(rows(spark, ("A", dt.date(2024, 3, 25), 200.0, 1.0, 1, 900)))
    assert (r.n_extreme, r.extreme_dates, r.usable) == (1, [dt.date(2024, 3, 25)], True)


def test_blocking_findings(spark):
    r = report(rows(spark, n=29))
    assert (r.usable, r.blocking) == (False, ["too few observations"])
    weekly = spark.createDataFrame([("A", dt.date(2023, 1, 2) + dt.timedelta(7 * k), 1.0, 1.0, 1, k) for k in range(60)], sources.SCHEMA)
    assert report(weekly).blocking == ["too sparse"]
    listed = spark.createDataFrame([("A",), ("B",)], "series_id string")
    got = one(sources.quality_report(rows(spark), NOW, listed), series_id="B")
    assert (got.n_observations, got.blocking, got.issues, got.usable) == (0, ["no data"], ["no data"], False)


def test_load_and_validate(spark, tmp_path):
    df = rows(spark).unionByName(rows(spark, n=10).withColumn("series_id", F.lit("B")))
    df.write.parquet(f"{tmp_path}/p")
    with pytest.raises(Exception, match="B: too few observations"):
        sources.load_and_validate(spark, f"{tmp_path}/p", now=NOW).collect()
    got = sources.load_and_validate(spark, f"{tmp_path}/p", now=NOW, strict=False)
    assert {r.series_id for r in got.collect()} == {"A"}


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    df = rows(spark, n=5)
    df.write.format(kind).save(f"{tmp_path}/x")
    assert sorted(map(tuple, sources.read_prices(spark, f"{tmp_path}/x", kind).collect())) == sorted(map(tuple, df.collect()))


def test_missing_adjusted_close(spark):
    df = spark.createDataFrame([("A", "2024-01-02", 5.0)], "ticker string, Date string, Close double")
    assert tuple(sources.normalised(df).first()) == ("A", dt.date(2024, 1, 2), 5.0, 5.0, None, 0)


def test_cache(spark, tmp_path):
    root = str(tmp_path / "cache")
    p = prices(spark, {"^GS/X": [1.0, 2.0], "B": [3.0]})
    sources.write_cache(p, root, "3y", F.lit("2024-05-31 12:00:00").cast("timestamp"))
    sources.write_cache(prices(spark, {"B": [7.0, 8.0]}), root, "3y", F.lit("2024-05-01").cast("timestamp"))
    got = sources.read_cache(spark, root, "3y")
    assert sorted((r.series_id, r.close) for r in got.collect()) == [("B", 7.0), ("B", 8.0), ("^GS/X", 1.0), ("^GS/X", 2.0)]
    assert sources.read_cache(spark, root, "3y", ["^GS/X"]).count() == 2
    assert sources.read_cache(spark, root, "1y").count() == 0
    s = {r.series_id: r for r in sources.status(got, F.lit(NOW)).collect()}
    assert (s["^GS/X"].freshness, s["B"].freshness) == ("DELAYED", "STALE")
    assert s["^GS/X"].age_minutes == pytest.approx(12 * 60)
    assert sources.cache_name("^GS/X") == "_GS_X"


def test_vendor_source(spark):
    def fetch(ticker, period):
        import datetime

        assert period == "1y"
        return [(datetime.date(2024, 1, 2), 10.0, None, 5), (datetime.date(2024, 1, 3), 11.0, 10.5, 6)] if ticker != "NONE" else []

    spark.dataSource.register(sources.vendor("test_vendor", fetch))
    df = spark.read.format("test_vendor").option("tickers", "A, B").option("period", "1y").load()
    assert sorted((r.series_id, r.close, r.adj_close, r.ingest_seq) for r in df.collect()) == [(t, c, a, k) for t in "AB" for c, a, k in ((10.0, 10.0, 0), (11.0, 10.5, 1))]
    with pytest.raises(Exception, match="no prices for NONE"):
        spark.read.format("test_vendor").option("tickers", "NONE").option("period", "1y").load().collect()


def test_only_the_first_extreme_days_are_listed(spark):
    jumps = [("A", d, 100.0 * (1 + k % 2), 1.0, 1, k) for k, d in enumerate(business_days(60, "2024-01-01"))]
    r = report(spark.createDataFrame(jumps, sources.SCHEMA))
    assert (r.n_extreme, r.extreme_dates) == (59, business_days(6, "2024-01-01")[1:])


def test_json_cache(spark, tmp_path):
    frame = pd.DataFrame({"close": [1.5, None], "adj_close": [1.25, 2.0], "volume": [10, 20]}, index=pd.to_datetime(["2024-01-02", "2024-01-03"]))
    for name, data in (("prices__GSPC_3y.json", frame.to_json(orient="split", date_format="iso")), ("prices_BAD_3y.json", "none")):
        (tmp_path / name).write_text(json.dumps({"fetched_at": "2024-01-04T10:00:00.5", "data": data}))
    got = sorted(tuple(r) for r in sources.read_json_cache(spark, str(tmp_path)).drop("fetched_at").collect())
    assert got == [("_GSPC", dt.date(2024, 1, 2), 1.5, 1.25, 10, 0, "3y"), ("_GSPC", dt.date(2024, 1, 3), None, 2.0, 20, 1, "3y")]
    fetched = sources.read_json_cache(spark, str(tmp_path)).select(F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("t")).distinct().collect()
    assert [r.t for r in fetched] == ["2024-01-04 10:00"]


def test_benchmark_names():
    assert (sources.benchmark_series("FTSE 100 (UK)"), sources.benchmark_series("^X")) == ("^FTSE", "^X")


def test_days_are_reduced_before_the_windows(spark):
    """Many arrivals a day reach the windows by series as one row a day; a row without a number comes before all others."""
    first = dt.date(2024, 1, 1)
    data = [("A", first + dt.timedelta(days=k % 40), 100.0 + n, 100.0 + n, 1, n) for n in range(50) for k in range(40)]
    data += [("A", first, 7.0, 7.0, 1, None), ("B", first, 9.0, None, 2, None)]
    df = spark.createDataFrame(data, "series_id string, d date, close double, adj_close double, volume long, ingest_seq long")
    report = sources.quality_report(df, dt.datetime(2024, 6, 1))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "row_number" not in plan
    got = {r.series_id: r for r in report.collect()}
    assert (got["A"].n_duplicates, got["A"].n_observations, got["B"].n_duplicates, got["B"].n_observations) == (49 * 40 + 1, 40, 0, 1)
    last = {(r.series_id, r.d): tuple(r) for r in sources.last_arrivals(df).collect()}
    assert len(last) == 41
    assert last["A", first] == ("A", first, 149.0, 149.0, 1, 49)
    assert last["B", first] == ("B", first, 9.0, None, 2, None)
