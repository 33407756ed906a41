import datetime as dt
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tailframe.sources import envelope
from tailframe.sources import prices as sources

from .helpers import prices

AT = "2024-05-01T10:00:00+00:00"


@pytest.fixture(scope="module")
def some(spark):
    return prices(spark, {"^IX": [1.0, 2.0, None], "a/b": [5.0, 6.0], "plain": [7.5]}).withColumn("close", F.col("close")).cache()


def rows(df):
    return sorted(((r.series_id, r.d, r.close, r.adj_close, r.volume) for r in df.collect()), key=str)


def test_round_trip(spark, some, tmp_path):
    path = f"{tmp_path}/cache"
    envelope.write_envelopes(some, path, "1y", AT)
    assert sorted(os.listdir(path)) == ["prices__IX_1y.json", "prices_a_b_1y.json", "prices_plain_1y.json"]
    got = envelope.read_envelopes(spark, path)
    want = some.withColumn("series_id", F.translate("series_id", "^/", "__"))
    assert rows(got) == rows(want)
    r = got.where("series_id = 'plain'").first()
    assert (r.period, r.ingest_seq) == ("1y", 0)
    assert got.select(F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("x")).distinct().collect() == [("2024-05-01 10:00",)]
    with open(f"{path}/prices__IX_1y.json") as f:
        e = json.load(f)
    assert e["fetched_at"] == AT
    assert json.loads(e["data"])["columns"] == ["close", "adj_close", "volume"]
    # The reader by Spark's own functions agrees.
    assert rows(sources.read_json_cache(spark, path)) == rows(want)


def test_append_and_overwrite(spark, some, tmp_path):
    path = f"{tmp_path}/cache"
    envelope.write_envelopes(some, path, "1y", AT)
    envelope.write_envelopes(some.where("series_id = 'plain'"), path, "5y", AT)
    envelope.write_envelopes(some.where("series_id = 'plain'").withColumn("close", F.lit(9.0)), path, "1y", AT)
    got = {(r.series_id, r.period): r.close for r in envelope.read_envelopes(spark, path).orderBy("d").collect()}
    assert got["plain", "1y"] == 9.0
    assert got["plain", "5y"] == 7.5
    assert len(os.listdir(path)) == 4
    envelope.write_envelopes(some.where("series_id = 'plain'"), path, "1y", AT, "overwrite")
    assert sorted(os.listdir(path)) == ["prices_plain_1y.json", "prices_plain_5y.json"]


def test_a_failed_task_leaves_no_file(spark, some, tmp_path):
    path = f"{tmp_path}/cache"
    envelope.write_envelopes(some.where("series_id = 'plain'"), path, "1y", AT)
    broken = some.withColumn("close", F.when(F.col("series_id") == "a/b", F.raise_error(F.lit("no price")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(PySparkException):
        envelope.write_envelopes(broken, path, "1y", AT)
    assert os.listdir(path) == ["prices_plain_1y.json"]


def test_names_that_clash_are_refused(spark, tmp_path):
    path = f"{tmp_path}/cache"
    with pytest.raises(PySparkException, match="two names are one file's"):
        envelope.write_envelopes(prices(spark, {"a/b": [1.0], "a^b": [2.0]}), path, "1y", AT)
    assert os.listdir(path) == []


def test_stream(spark, some, tmp_path):
    path, out = f"{tmp_path}/cache", f"{tmp_path}/out"

    def catch_up():
        s = envelope.read_envelopes(spark, path, stream=True)
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(s.schema).parquet(out).count()

    os.makedirs(out)
    envelope.write_envelopes(some.where("series_id = 'a/b'"), path, "1y", AT)
    assert catch_up() == 2
    assert catch_up() == 2
    envelope.write_envelopes(some.where("series_id = '^IX'"), path, "1y", AT)
    assert catch_up() == 5


def test_files_that_are_no_envelopes(spark, tmp_path):
    for name, text in (("prices_x_1y.json", "{"), ("prices_y_1y.json", '{"fetched_at": "2024-01-01", "data": "[]"}'), ("other.json", "{}")):
        (tmp_path / name).write_text(text)
    (tmp_path / "prices_z_1y.json").write_text(json.dumps({"fetched_at": "2024-01-01T00:00:00", "data": json.dumps({"columns": ["close"], "index": ["2024-01-02"], "data": [[3]]})}))
    (r,) = envelope.read_envelopes(spark, str(tmp_path)).collect()
    assert (r.series_id, r.d, r.close, r.adj_close, r.volume) == ("z", dt.date(2024, 1, 2), 3.0, 3.0, None)
    assert envelope.read_envelopes(spark, f"{tmp_path}/absent").collect() == []
