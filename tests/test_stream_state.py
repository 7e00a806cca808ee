import datetime as dt

import pytest
from pyspark.sql import functions as F

from newstape.operators import scans
from newstape.schema import TICKS
from newstape.sources import views
from newstape.streaming import ema, jobs

SPANS = {"e12": 12, "e2": 2}


@pytest.fixture(scope="module")
def ticks(spark, sf_dir):
    rows = views.ticks(spark, sf_dir)
    return rows.withColumn("ticker", F.nullif("ticker", F.lit("click"))).withColumn("ts", F.col("ts").cast("timestamp"))


def part(df, path, number):
    df.coalesce(1).write.mode("append").parquet(f"{path}/part={number}")


def test_averages_on_the_state_store_go_on_after_a_restart(spark, ticks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    days = [dt.datetime(2024, 1, d) for d in (1, 7, 13, 19, 25)]
    bounds = [*days[1:], dt.datetime(2025, 1, 1)]
    for i in range(3):
        part(ticks.where((F.col("ts") >= days[i]) & (F.col("ts") < bounds[i])), source, i)

    def stream():
        return jobs.stream_ticks(spark, f"{source}/*", TICKS, files_per_trigger=1)

    first = ema.stream_carries(stream(), out, SPANS, slot="6 hours", delay="1 day").count()
    for i in (3, 4):
        part(ticks.where((F.col("ts") >= days[i]) & (F.col("ts") < bounds[i])), source, i)
    late = spark.createDataFrame([("view", dt.datetime(2024, 3, 1), 10**9, 1.0)], TICKS)
    part(late.select(ticks.columns), source, 5)
    carries = ema.stream_carries(stream(), out, SPANS, slot="6 hours", delay="1 day")
    assert 0 < first < carries.count()
    got = ema.averages_of_slots(ticks, carries, SPANS, slot="6 hours")
    whole = scans.ema(ticks, {"b12": ("price", 12), "b2": ("price", 2)}, order=["ts", "event_id"])
    both = got.join(whole.select("event_id", "b12", "b2"), "event_id")
    assert both.count() == ticks.count() and got.where("ticker is null").count() > 0
    gap = both.agg(F.max(F.abs(F.col("e12") - F.col("b12"))), F.max(F.abs(F.col("e2") - F.col("b2")))).first()
    assert max(gap) < 1e-9


def day(d, hour=12):
    return dt.datetime(2024, 1, d, hour)


def test_bars_and_headlines_of_two_streams(spark, tmp_path):
    bar_dir, news_dir = str(tmp_path / "bars"), str(tmp_path / "news")
    bar_kind = "ticker string, ts timestamp, close double"
    news_kind = "ticker string, ts timestamp, headline string, sentiment_compound double"
    bars = [
        [("A", day(1), 1.0), ("B", day(1), 2.0), (None, day(1), 3.0)],
        [("A", day(2), 4.0)],
        [("A", day(6), 5.0)],
        [("B", day(1), 99.0), ("A", day(20), 6.0)],  # the first one is too late
        [("A", day(25), 7.0)],
    ]
    news = [
        [("A", day(1), "x", 0.5), ("A", day(1, 9), "y", 0.1), (None, day(1), "n", -0.5)],
        [("A", day(2), "z", 0.2), ("C", day(2), "no bar", 0.9)],
        [("B", day(6), "w", 0.3)],
        [("A", day(2), "too late", 1.0), ("A", day(20), "v", 0.4)],
        [("A", day(25), "u", 0.0)],
    ]
    for i, (b, n) in enumerate(zip(bars, news)):
        part(spark.createDataFrame(b, bar_kind), bar_dir, i)
        part(spark.createDataFrame(n, news_kind), news_dir, i)

        def joined():
            left = jobs.stream_files(spark, f"{bar_dir}/*", bar_kind, files_per_trigger=1)
            right = jobs.stream_files(spark, f"{news_dir}/*", news_kind, files_per_trigger=1)
            return jobs.stream_join_streams(left, right)

        out = jobs.run_once(joined(), str(tmp_path / "out"))  # a run for each pair of files: four restarts
    got = sorted(((r.ticker, r.date.day, r.close, round(r.sentiment_score, 6), r.headline_count) for r in out.collect()), key=str)
    assert got == sorted([("A", 1, 1.0, 0.3, 2), ("B", 1, 2.0, 0.0, 0), (None, 1, 3.0, -0.5, 1), ("A", 2, 4.0, 0.2, 1), ("A", 6, 5.0, 0.0, 0), ("A", 20, 6.0, 0.4, 1)], key=str)


def test_windows_from_panes(spark, tmp_path):
    rows = [("A", day(1), "a", 0.5), ("A", day(1), "b", None), ("A", day(3), "c", 0.1), ("B", day(9), None, -0.2)]
    frame = spark.createDataFrame(rows, "ticker string, ts timestamp, headline string, sentiment_compound double")
    batch = jobs.window_sentiment(frame.withColumn("date", F.col("ts").cast("date")), 3)
    got = {(r.ticker, r.date.isoformat()): (r.sentiment_score, r.headline_count) for r in batch.collect()}
    assert len(got) == 5 + 3
    assert got["A", "2024-01-01"] == (pytest.approx(0.3), 3) and got["A", "2024-01-02"] == (0.1, 1) and got["B", "2024-01-07"] == (-0.2, 0)
    for i, r in enumerate(rows):
        part(spark.createDataFrame([r], frame.schema), str(tmp_path / "in"), i)
    stream = jobs.stream_files(spark, f"{tmp_path}/in/*", "ticker string, ts timestamp, headline string, sentiment_compound double", files_per_trigger=1)
    out = jobs.stream_window_sentiment(stream, str(tmp_path / "out"), 3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select(out.columns).collect()))
