import datetime as dt
import math

import pytest

from tailframe.functions import sql
from tailframe.operators import drawdown
from tailframe.streaming import live

from .helpers import normal_returns, prices


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    return spark


def test_scalar_functions(registered):
    q = "SELECT risk_score(0.35D, 0.15D, 0.55D), risk_score(NULL, 0D, 1D), log_loss(ln(0.9D)), scale_days(2D, 4), basel_zone(5, 250), risk_rating(55D), chi2_tail_1(3.841458820694124D), t_quantile(0.05D, 4D), t_p_value(2D, 10D)"
    r = registered.sql(q).first()
    assert (r[1], r[4], r[5]) == (None, "yellow", "Elevated")
    assert (r[0], r[2], r[3], r[6], r[7], r[8]) == pytest.approx((50, 0.1, 4, 0.05, -2.13184678632665, 0.07338803477), rel=1e-8)


def test_table_function_equals_the_operator(registered):
    import numpy as np

    p = prices(registered, {k: 100 * np.exp(np.cumsum(normal_returns(400, s))) for k, s in (("A", 1), ("B", 2))})
    p.selectExpr("series_id", "d", "close AS p").createOrReplaceTempView("levels")
    got = registered.sql("SELECT * FROM drawdown_episodes(0.08D, TABLE(levels) PARTITION BY series_id ORDER BY d)").collect()
    want = drawdown.drawdown_episodes(p, 0.08).collect()
    key = lambda r: (r.series_id, r.peak_date, r.trough_date, round(r.depth, 9), r.recovery_date)
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)
    assert want


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Four files of events; the third holds a late row, the fourth one that is too late."""
    at = tmp_path_factory.mktemp("events")
    base = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    files = [
        [(k, base + dt.timedelta(minutes=20 * k), k % 2, "a", 100.0 + k, "{}") for k in range(9)],
        [(20 + k, base + dt.timedelta(hours=3, minutes=20 * k), 1, "a", 120.0 + k, "{}") for k in range(9)],
        [(40, base + dt.timedelta(hours=5, minutes=1), 1, "a", 500.0, "{}"), (41, base + dt.timedelta(hours=9), 1, "a", 130.0, "{}")],
        [(60, base + dt.timedelta(hours=1), 1, "a", 9999.0, "{}"), (61, base + dt.timedelta(hours=14), 1, "a", 140.0, "{}")],
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/stage{k}")
        part = next((at / f"stage{k}").glob("*.parquet"))
        (at / "in").mkdir(exist_ok=True)
        part.rename(at / "in" / f"{k}.parquet")
        import os

        os.utime(at / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(at / "in"), files


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(60)
    return df.sparkSession.table(name).collect()


def test_windows_take_late_rows_and_drop_too_late_ones(spark, events):
    folder, files = events
    rows = run(live.window_means(live.event_stream(spark, folder)), "means")
    got = {r.d: (r.close, r.volume) for r in rows}
    five = [v for f in files[:3] for _, ts, _, _, v, _ in f if ts.hour == 5]
    assert got[dt.datetime(2024, 1, 1, 5)] == (pytest.approx(sum(five) / len(five)), len(five))
    assert all(r.close < 9999 / 2 for r in rows)


def test_sessions(spark, events):
    rows = run(live.session_totals(live.event_stream(spark, events[0])), "sessions")
    assert sum(r.n for r in rows) >= 9
    assert all(r.end > r.start for r in rows)


def test_state_across_batches(spark, events):
    stream = live.event_stream(spark, events[0]).selectExpr("event_type AS series_id", "ts AS d", "value AS close")
    got = sorted((r.d, r.ewma_volatility) for r in run(live.weighted_variance(stream), "ewma"))
    values, last, prev, v = [], None, None, math.nan
    for f in events[1]:
        for _, ts, _, _, x, _ in sorted(f, key=lambda r: r[1]):
            if last is not None and ts <= last:
                continue
            if prev is not None:
                r = math.log(x / prev)
                v = r * r if math.isnan(v) else 0.94 * v + 0.06 * r * r
                values.append((ts, math.sqrt(v)))
            last, prev = ts, x
    assert [d for d, _ in got] == [d for d, _ in values]
    assert [x for _, x in got] == pytest.approx([x for _, x in values])


def test_history_by_batch(spark, events, tmp_path):
    seen = []
    stream = live.event_stream(spark, events[0]).selectExpr("event_type AS series_id", "ts AS d", "value AS close", "value AS adj_close")
    q = stream.writeStream.foreachBatch(live.keep_history(str(tmp_path / "h"), lambda m, k: seen.append((k, m.first().n_observations)))).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    assert [n for _, n in seen] == [8, 17, 19, 21]
