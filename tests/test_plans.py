"""What the plans must look like, and that one hot key meets many tasks."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from newstape.functions.lexicon import FINANCE_TERMS
from newstape.operators import backtest, blocks, network, ordering, profile, scans, sentiment, series
from newstape.sources import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_scoring_is_one_stage_without_python(spark, sf_dir):
    text = plan(sentiment.score_news(views.news(spark, sf_dir), FINANCE_TERMS))
    assert "Exchange" not in text and "Python" not in text


def test_no_python_in_the_core(spark, sf_dir):
    bars = views.bars(spark, sf_dir)
    daily = bars.select("ticker", "date", F.lit(0.1).alias("sentiment_score"), F.lit(1).alias("headline_count"))
    for df in (series.add_technical_indicators(bars), backtest.sentiment_returns(bars, daily), ordering.time_series_folds(bars)):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df)


def test_rolling_indicators_share_one_window_pass(spark, tmp_path, sf_dir):
    path = str(tmp_path / "bars")
    views.bars(spark, sf_dir).write.parquet(path)
    bars = spark.read.parquet(path)
    df = series.add_technical_indicators(bars, ["SMA20", "SMA50", "BB"])
    # rows: by bucket, by block; bucket counts: two small ones
    assert exchanges(df) <= 4
    assert len(re.findall(r"partition=|windowspecdefinition\(ticker#\d+, _blk", plan(df))) > 0


def test_frames_never_partition_by_ticker_alone(spark, tmp_path, sf_dir):
    """Row-level windows hold a calendar bucket or a block; only summaries are ordered per ticker."""
    path = str(tmp_path / "bars")
    views.bars(spark, sf_dir).write.parquet(path)
    bars = spark.read.parquet(path)
    for df in (series.sma(bars), series.rsi(bars), scans.ema(bars, {"e": ("close", 12)}), series.drawdown(bars, "close")):
        for spec in re.findall(r"windowspecdefinition\((.*?)(?: ASC| DESC)", plan(df)):
            if "ticker" in spec and not re.search(r"_bucket|_blk|_sub", spec):
                pytest.fail(spec)


@pytest.fixture(scope="module")
def hot(spark):
    """One ticker with 50,000 minutes next to 50 small ones."""
    start = dt.datetime(2020, 1, 1)
    ids = spark.range(0, 50000).select(F.lit("HOT").alias("ticker"), "id")
    small = spark.range(0, 1000).select(F.concat(F.lit("T"), F.col("id") % 50).alias("ticker"), F.floor(F.col("id") / 50).alias("id"))
    rows = ids.unionByName(small)
    ts = F.lit(start).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))
    return rows.select("ticker", ts.alias("ts"), (F.abs(F.hash("ticker", "id")) % 1000 / 10.0 + 1).alias("close"))


def test_hot_ticker_is_cut_into_blocks(hot):
    day = F.unix_date(F.col("ts").cast("date"))
    spread = blocks.blocks(blocks.row_index(hot, order="ts", bucket=day), back=49, size=4096)
    sizes = spread.where("ticker = 'HOT'").groupBy("_blk").agg(F.count("*").alias("n"))
    assert sizes.count() == 13 and sizes.agg(F.max("n")).first()[0] <= 4096 + 49


def test_hot_ticker_results(hot):
    pdf = hot.where("ticker='HOT'").orderBy("ts").toPandas()
    day = F.unix_date(F.col("ts").cast("date"))
    out = scans.ema(hot, {"e": ("close", 26)}, order="ts", bucket=day).where("ticker='HOT'").orderBy("ts").toPandas()
    expected = pdf.close.ewm(span=26, adjust=False).mean()
    assert abs(out.e - expected).max() < 1e-9
    out = series.sma(hot, (50,), order="ts", bucket=day).where("ticker='HOT'").orderBy("ts").toPandas()
    assert abs(out.sma50 - pdf.close.rolling(50).mean()).max() < 1e-9


def test_copies_are_merged_before_the_shuffle(spark, sf_dir):
    news = views.news(spark, sf_dir).select("ticker", "headline", "doc_id")
    text = plan(ordering.dedup_headlines(news, ["doc_id"]))
    assert "partial_min" in text and "Window" not in text


def test_top_rows_are_limited_before_the_shuffle(spark, tmp_path, sf_dir):
    path = str(tmp_path / "bars")
    views.bars(spark, sf_dir).write.parquet(path)
    assert "WindowGroupLimit" in plan(ordering.recent(spark.read.parquet(path), 10))


def test_edges_of_one_huge_text(spark):
    """A text with 700 entities is dealt out to three slices and still gives every pair once."""
    ents = spark.range(0, 700).select(
        F.lit("one").alias("doc"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("entity"),
        F.lit("ORG").alias("entity_type"), F.col("id").alias("row_id"),
    )
    edges = network.entity_edges(ents, network.entity_counts(ents))
    assert edges.count() == 700 * 699 // 2 and edges.agg(F.max("weight")).first()[0] == 1


def test_no_forced_broadcast_of_data(spark, sf_dir):
    ents = views.entities(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(network.entity_edges(ents, network.entity_counts(ents)))
        text += plan(profile.exact_quantiles(views.bars(spark, sf_dir), "close"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in text


def test_pairs_are_made_without_sorted_joins(spark):
    """Rows of texts in a range pass a hash join, and pairs come from lists: no task sorts the mentions, so its memory stays small."""
    ents = spark.range(0, 4000).select(
        (F.col("id") % 900).alias("doc"), F.concat(F.lit("e"), F.col("id") % 7).alias("entity"), F.lit("ORG").alias("entity_type"), F.col("id").alias("row_id"),
    )
    news = spark.range(0, 900).select(F.col("id").alias("doc"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = network.network_in_range(ents, news, F.col("date") < "2024-01-15", 1, link="doc").edges
        text = plan(edges)
        found = {(r.entity1, r.entity2): r.weight for r in edges.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.findall(r"SortMergeJoin \[doc#\d+L\], \[doc#\d+L\], LeftSemi", text)
    assert not re.findall(r"SortMergeJoin \[doc#\d+L?, _slice", text)
    kept = [(i % 900, f"e{i % 7}") for i in range(4000) if (i % 900) % 50 < 14]
    expected = {}
    for doc in {d for d, _ in kept}:
        names = [e for d, e in kept if d == doc]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                pair = (min(a, b), max(a, b))
                expected[pair] = expected.get(pair, 0) + 1
    assert found == expected


@pytest.fixture
def as_dealt(spark):
    """Shuffle partitions as they are dealt, not merged afterwards."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def million_ticks(spark):
    """A million ticks of one ticker in one hour, most of them in a burst of a second, and a few of others."""
    micros = F.when(F.col("id") % 4 == 0, F.col("id") * 3600).otherwise(1_800_000_000 + F.col("id"))
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000 // 3_600_000_000 * 3_600_000_000) + micros)
    hot = spark.range(0, 1_000_000, numPartitions=8).select(F.lit("HOT").alias("ticker"), ts.alias("ts"), (F.col("id") % 97).cast("double").alias("close"))
    return hot.unionByName(hot.where("close = 5").limit(50).withColumn("ticker", F.lit("COLD")))


def test_a_crowded_hour_meets_many_tasks(spark, as_dealt):
    numbered = blocks.row_index(million_ticks(spark), order="ts")
    tasks = numbered.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("row_idx")).toPandas().n
    assert len(tasks) == 4 and tasks.max() < 2 * tasks.median()
    seen = numbered.where("ticker = 'HOT'").agg(F.count_distinct("row_idx"), F.min("row_idx"), F.max("row_idx"), F.max("row_cnt")).first()
    assert tuple(seen) == (1_000_000, 0, 999_999, 1_000_000)


@pytest.mark.parametrize("order", ["ts", ["ts", "place"]])
def test_crowded_hours_are_numbered_as_by_one_window(spark, monkeypatch, order):
    """Hours from 200 rows on are cut; many rows share an instant, some have none, keys may be NULL."""
    monkeypatch.setattr(blocks, "CROWDED_ROWS", 200)
    monkeypatch.setattr(blocks, "SAMPLED_ROWS", 64)
    monkeypatch.setattr(blocks, "PIECES", 8)
    ids = spark.range(0, 3000, numPartitions=3)
    second = F.when(F.col("id") % 50 == 3, None).otherwise(F.pmod(F.hash("id"), F.lit(9000)))
    instant = second if isinstance(order, list) else F.when(F.col("id") % 50 != 3, F.col("id") * 3)
    rows = ids.select(
        F.when(F.col("id") % 10 < 8, "a").when(F.col("id") % 10 < 9, "b").alias("ticker"),
        F.timestamp_seconds(F.lit(1_700_000_000) + instant).alias("ts"),
        (F.lit(7 * 4096) - F.col("id") * 5).alias("place"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 1.0).alias("x"),
    )
    out = blocks.restore_keys(blocks.row_index(blocks.fill_keys(rows, "ticker"), order=order, fill=["x"]), "ticker").toPandas()
    by = order if isinstance(order, list) else ["ts"]
    for _, own in out.groupby("ticker", dropna=False):
        dated = own.sort_values(by, na_position="first", kind="stable") if len(by) > 1 else own.sort_values("row_idx")
        assert list(dated.row_idx) == list(range(len(own))) and set(own.row_cnt) == {len(own)}
        if len(by) > 1:
            filled = dated.x.ffill()
            assert (dated._fill_x.fillna(-1) == filled.fillna(-1)).all()
        else:
            assert dated.ts.isna().to_numpy()[: dated.ts.isna().sum()].all() and dated.ts.dropna().is_monotonic_increasing
