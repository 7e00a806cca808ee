import datetime as dt

import pytest
from pyspark.sql import functions as F

from newstape.operators import scans, series
from newstape.operators.blocks import row_index
from newstape.plans import catalog
from newstape.schema import TICKS
from newstape.sources import views
from newstape.streaming import ema, jobs


def slices(df, path, cuts):
    """Write time slices as single files, oldest first."""
    for i, condition in enumerate(cuts):
        df.where(condition).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")


@pytest.fixture(scope="module")
def ticks(spark, sf_dir):
    return views.ticks(spark, sf_dir)


@pytest.fixture(scope="module")
def tick_dir(ticks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks"))
    days = [dt.datetime(2024, 1, d) for d in (1, 8, 15, 22, 31)]
    cuts = [F.col("ts") < days[1]] + [F.col("ts").between(a, b - dt.timedelta(microseconds=1)) for a, b in zip(days[1:], days[2:])]
    cuts.append(F.col("ts") >= days[-1])
    slices(ticks, path, cuts)
    return path


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(a.columns)).count() == 0


def test_bars_in_batches_equal_batch(spark, ticks, tick_dir, tmp_path):
    stream = jobs.stream_ticks(spark, f"{tick_dir}/*", TICKS, files_per_trigger=1)
    out = jobs.run_once(jobs.stream_bars(stream), str(tmp_path / "o"), "update", ["ticker", "bar_start"])
    assert same(out, series.bars_from_ticks(ticks))


def test_ema_goes_on_across_batches(spark, ticks, tick_dir, tmp_path):
    stream = jobs.stream_ticks(spark, f"{tick_dir}/*", TICKS, files_per_trigger=1)
    out = ema.stream_ema(stream, str(tmp_path / "o"), {"e12": 12, "e2": 2})
    batches = spark.read.parquet(str(tmp_path / "o" / "rows")).select("batch").distinct().count()
    assert batches >= 4
    whole = scans.ema(ticks, {"b12": ("price", 12), "b2": ("price", 2)}, order=["ts", "event_id"])
    both = out.join(whole.select("ticker", "event_id", "b12", "b2"), ["ticker", "event_id"])
    assert both.count() == ticks.count()
    gap = both.agg(F.max(F.abs(F.col("e12") - F.col("b12"))), F.max(F.abs(F.col("e2") - F.col("b2")))).first()
    assert max(gap) < 1e-9


def test_repeated_batch_does_not_double(spark, ticks, tick_dir, tmp_path):
    stream = jobs.stream_ticks(spark, f"{tick_dir}/*", TICKS)
    a = jobs.run_once(stream.select("event_id"), str(tmp_path / "o"))
    assert a.count() == ticks.count()
    b = jobs.run_once(stream.select("event_id"), str(tmp_path / "o"))
    assert b.count() == ticks.count()


def test_sessions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    minutes = [0, 29, 30, 59, 89, 120, 151, 300, 301]
    rows = [("A", at + dt.timedelta(minutes=m), i, 1.0) for i, m in enumerate(minutes)] + [("B", at, 99, 1.0)]
    df = spark.createDataFrame(rows, TICKS)
    batch = jobs.burst_sessions(df)
    found = sorted((r.ticker, r.session_start.hour * 60 + r.session_start.minute - 600, r.events) for r in batch.collect())
    plain = df.groupBy("ticker", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    expected = sorted((r.ticker, r.w.start.hour * 60 + r.w.start.minute - 600, r.events) for r in plain.collect())
    assert found == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_ticks(spark, str(tmp_path / "in"), TICKS)
    out = jobs.run_once(jobs.burst_sessions_stream(stream), str(tmp_path / "o"))
    closed = {(r.ticker, r.events) for r in out.collect()}
    assert closed <= {(t, n) for t, _, n in expected}
    every = jobs.stream_bursts(jobs.stream_ticks(spark, str(tmp_path / "in"), TICKS), str(tmp_path / "b"))
    assert sorted(map(str, every.collect())) == sorted(map(str, batch.select(every.columns).collect()))


def news_slices(spark, path):
    day = dt.datetime(2024, 1, 1)
    rows = [
        [("A", day, "profit gains"), ("A", day, "profit gains"), ("B", day, "loss")],
        [("A", day + dt.timedelta(days=1), "profit"), ("A", day + dt.timedelta(hours=5), "loss")],
        [("B", day + dt.timedelta(days=9), "gain")],
        [("B", day + dt.timedelta(days=9), "gain")],
        # Late rows are judged by the watermark of the batch before.
        [("A", day, "far too late")],
    ]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "ticker string, ts timestamp, headline string").coalesce(1).write.parquet(f"{path}/part={i}")
    return "ticker string, ts timestamp, headline string"


def test_daily_sentiment_late_rows_and_dedup(spark, tmp_path):
    shape = news_slices(spark, str(tmp_path / "in"))
    news = lambda: jobs.stream_news(spark, f"{tmp_path}/in/*", shape, files_per_trigger=1)
    daily = jobs.stream_daily_sentiment(jobs.stream_scores(news()))
    out = jobs.run_once(daily, str(tmp_path / "d"), "update", ["ticker", "date"])
    got = {(r.ticker, r.date.day): r.headline_count for r in out.collect()}
    # the row nine days behind the newest one is past the watermark and left out
    assert got == {("A", 1): 3, ("B", 1): 1, ("A", 2): 1, ("B", 10): 2}
    for salts in (1, 3):
        unique = jobs.run_once(jobs.stream_dedup(news(), salts=salts), str(tmp_path / f"u{salts}"))
        heads = sorted((r.ticker, r.headline) for r in unique.collect())
        assert heads == [("A", "loss"), ("A", "profit"), ("A", "profit gains"), ("B", "gain"), ("B", "loss")]
    assert heads == [("A", "loss"), ("A", "profit"), ("A", "profit gains"), ("B", "gain"), ("B", "loss")]
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 1), 5.0)], "ticker string, date date, close double")
    joined = jobs.run_once(
        jobs.stream_join_bars(jobs.stream_daily_sentiment(jobs.stream_scores(news())), bars),
        str(tmp_path / "j"), "update", ["ticker", "date"],
    )
    assert {(r.ticker, r.date.day): r.close for r in joined.collect()}[("A", 1)] == 5.0
    later = jobs.bars_with_streamed_sentiment(bars, out)
    assert later.first().headline_count == 3


@pytest.mark.parametrize("name", ["stream_scores", "stream_dedup", "stream_daily", "stream_week", "stream_join_bars"])
def test_tables_in_part_files(spark, tmp_path, name):
    rows = [(i, text, "en", "web", len(text)) for i, text in enumerate(["that was", "with this", "from that", "with", "for this", "was"] * 2)]
    news = spark.createDataFrame(rows, catalog.DOCUMENTS_SCHEMA)
    day = dt.datetime(1995, 1, 1)
    orders = spark.createDataFrame([(i, 1, "O", 5.0 + i, day, t) for i, t in enumerate(views.PRIORITIES)], catalog.ORDERS_SCHEMA)
    for parts in (1, 3):
        news.repartition(parts, "doc_id").write.parquet(f"{tmp_path}/{parts}/documents.parquet")
        orders.write.parquet(f"{tmp_path}/{parts}/orders.parquet")
    one = tmp_path / "one"
    one.mkdir()
    for table in ("documents", "orders"):
        spark.read.parquet(f"{tmp_path}/1/{table}.parquet").toPandas().to_parquet(one / f"{table}.parquet", coerce_timestamps="us")
    found = [sorted(map(str, catalog.QUERIES[name](spark, str(d)).collect())) for d in (one, tmp_path / "1", tmp_path / "3")]
    assert found[0] and found[0] == found[1] == found[2]


@pytest.mark.parametrize("column", ["_n", "_us", "_cuts"])
def test_series_of_times_may_have_any_columns(spark, column, monkeypatch):
    monkeypatch.setattr("newstape.operators.blocks.CROWDED_ROWS", 4)
    at = dt.datetime(2024, 1, 1, 10)
    rows = [("A", at + dt.timedelta(minutes=m), 100 - m) for m in range(30)]
    df = spark.createDataFrame(rows, f"ticker string, ts timestamp, {column} int")
    found = row_index(df, order="ts").select("row_idx", "row_cnt", column).collect()
    assert sorted(map(tuple, found)) == [(m, 30, 100 - m) for m in range(30)]
