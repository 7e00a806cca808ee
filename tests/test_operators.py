import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newstape.operators import backtest, daily, entities, joins, network, ordering, profile
from newstape.schema import normalize_columns, pick_column

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- network --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_entities(spark):
    data = [("t1", "A"), ("t1", "B"), ("t1", "A"), ("t2", "A"), ("t2", "C"), ("t3", "B"), ("t3", "C"), ("t3", "D"), (None, "D")]
    data = [(i, t, e, f"type{i}") for i, (t, e) in enumerate(data[:-1])] + [(9, None, "Z", "x")]
    return spark.createDataFrame(data, "row_id bigint, doc string, entity string, entity_type string")


@pytest.mark.parametrize("pair_slice", [1, 2, 256])
def test_edges_golden(small_entities, pair_slice):
    counts = network.entity_counts(small_entities)
    assert rows(counts, "entity", "size") == [("A", 3), ("B", 2), ("C", 2), ("D", 1), ("Z", 1)]
    assert network.effective_threshold(counts.where("entity <> 'Z'"), 2).first().threshold == 1
    assert network.effective_threshold(counts, 3).first().threshold == 1
    edges = network.entity_edges(small_entities, counts, pair_slice=pair_slice)
    assert rows(edges, "entity1", "entity2", "weight") == [
        ("A", "A", 1), ("A", "B", 2), ("A", "C", 1), ("B", "C", 1), ("B", "D", 1), ("C", "D", 1),
    ]


def test_network_parts(small_entities):
    net = network.entity_network(small_entities, 1, top=2)
    assert rows(net.nodes, "entity", "size", "entity_type") == [
        ("A", 3, "type0"), ("B", 2, "type1"), ("C", 1, "MISC"), ("D", 1, "MISC"),
    ]
    assert net.status.first().status == "ok"
    assert network.max_weight(net.edges).first().max_weight == 2
    strict = network.entity_network(small_entities, 1, top=2, strict_top_n=True)
    assert rows(strict.edges, "entity1", "entity2") == [("A", "A"), ("A", "B")]
    alone = network.entity_network(small_entities.where("entity = 'A'"), 2)
    assert alone.status.first().status == "not enough entities"
    assert alone.nodes.count() == 0 and alone.edges.count() == 0


def test_edges_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"doc": rng.integers(0, 30, 900) ** 2 % 17, "entity": [f"e{i}" for i in rng.integers(0, 40, 900)]})
    pdf["row_id"], pdf["entity_type"] = range(900), "ORG"
    expected = {}
    for _, g in pdf.groupby("doc"):
        names = g.entity.tolist()
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                k = tuple(sorted((a, b)))
                expected[k] = expected.get(k, 0) + 1
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    edges = network.entity_edges(df, network.entity_counts(df), pair_slice=7)
    assert {(r.entity1, r.entity2): r.weight for r in edges.collect()} == expected


def test_network_in_range(spark):
    ents = spark.createDataFrame([(1, "h1", "A", "x"), (2, "h1", "B", "x"), (3, "h2", "C", "x")], "row_id int, source_text string, entity string, entity_type string")
    news = spark.createDataFrame([("h1", D(2024, 1, 1)), ("h2", D(2024, 2, 1)), ("h1", D(2024, 1, 2))], "source_text string, date date")
    net = network.network_in_range(ents, news, F.col("date") < "2024-01-15", 1, text="source_text")
    assert rows(net.edges, "entity1", "entity2", "weight") == [("A", "B", 1)]


# --- entities -------------------------------------------------------------------------------------


def test_patterns_and_gazetteer(spark):
    df = spark.createDataFrame([(1, "Acme Corp paid $2.5 billion on May 3, 2021, up 4.5% (Acme)", D(2021, 5, 3)), (2, None, None)], "doc_id int, headline string, date date")
    gaz = spark.createDataFrame([("Acme Corp", "ORG"), ("Acme", "ORG"), ("X", "ORG"), ("up", "MISC")], "entity string, entity_type string")
    out = entities.extract_entities(df, gazetteer=gaz)
    assert rows(out, "entity", "entity_type") == [
        ("$2.5 billion", "MONEY"), ("4.5%", "PERCENT"), ("Acme", "ORG"), ("Acme Corp", "ORG"), ("May 3, 2021", "DATE"),
    ]
    assert out.first().date == D(2021, 5, 3)


def test_patterns_are_tried_only_where_they_can_begin(spark):
    """Every pattern looks at one character before its alternatives, and finds what the plain pattern finds."""
    months = "January Jan February Feb March Mar April Apr May June Jun July Jul August Aug September Sept Sep October Oct November Nov December Dec"
    texts = [f"x{m} 3, 2021 and {m}. 14 {m}uary {m.lower()} 5" for m in months.split()]
    texts += ["$5 $1,200.50 million €3 £7 thousand ¥9 $", "5% 5.5 percent 12 % .5% 1.2.3% percent", "2021-03-04 12021-03-045 2021-3-4", "", "JJan 1 FMay 22 7May 7 D 1 Okt 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, headline string")
    found = entities.pattern_entities(df, ["doc_id"], "headline")
    assert found._jdf.queryExecution().analyzed().toString().count("(?=[") == len(entities.PATTERNS)
    expected = {(i, kind, m.group()) for i, t in enumerate(texts) for kind, p in entities.PATTERNS.items() for m in re.finditer(p, t)}
    assert {(r.doc_id, r.entity_type, r.entity) for r in found.collect()} == expected and len(expected) > 50


def test_model_mode_last_label_wins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id int, headline string")

    def load():
        return lambda text: [("Bob", "ORG"), ("Bob", "PERSON"), ("Z", "ORG"), ("Paris", "CARDINAL")]

    out = entities.extract_entities(df, load_model=load, keep=())
    assert rows(out, "doc_id", "entity", "entity_type") == [(1, "Bob", "PERSON")]


# --- ordering -------------------------------------------------------------------------------------


def test_split_and_folds(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1) + dt.timedelta(days=i), i) for i in range(23)], "ticker string, date date, i int")
    ten = ordering.time_split(df.where("i < 10"), 0.2)
    assert [r.role for r in ten.orderBy("i").collect()] == ["train"] * 8 + ["test"] * 2
    folds = ordering.time_series_folds(df).groupBy("fold", "role").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    assert rows(folds, "fold", "role", "a", "b") == [(0, "test", 9, 15), (0, "train", 0, 8), (1, "test", 16, 22), (1, "train", 0, 15)]


def test_dedup_and_combine(spark):
    a = spark.createDataFrame([(0, "T", D(2024, 1, 1), "x"), (1, "T", D(2024, 1, 3), "y"), (2, "T", D(2024, 1, 5), "x")], "row_idx int, ticker string, date date, headline string")
    b = spark.createDataFrame([(0, "T", D(2024, 1, 4), "y"), (1, "T", D(2024, 1, 2), "z")], "row_idx int, ticker string, date date, headline string")
    out = [(r.headline, r.date.day, r.source_rank) for r in ordering.combine_sources([a, None, b]).collect()]
    assert out == [("y", 3, 0), ("z", 2, 2), ("x", 1, 0)]


def test_recent_best_and_importance(spark):
    df = spark.createDataFrame([("A", D(2024, 1, i)) for i in range(1, 9)] + [("B", D(2024, 1, 1))], "ticker string, date date")
    assert [d.day for _, d in rows(ordering.recent(df, 3), "ticker", "date")] == [6, 7, 8, 1]
    res = spark.createDataFrame([("m1", 0.5, 0), ("m2", 0.7, 1), ("m3", 0.7, 2)], "model_name string, f1 double, train_order int")
    assert ordering.best_model(res).first().model_name == "m2"
    imp = ordering.sort_importance(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 3.0)], "feature string, coefficient double"))
    assert [(r.feature, r.average_coefficient) for r in imp.collect()] == [("b", 3.0), ("a", 2.0)]


# --- daily and joins ------------------------------------------------------------------------------


def scored(spark):
    data = [
        ("A", "2024-01-01", "h1", 0.5, "1"), ("A", "2024-01-01", "h2", 0.1, "3"), ("A", "today", None, -0.2, "5"), ("B", "2024-01-02", "h3", 0.0, None),
    ]
    df = spark.createDataFrame(data, "ticker string, date string, headline string, sentiment_compound double, rank string")
    return df.withColumns({"sentiment_positive": F.lit(0.2), "sentiment_neutral": F.lit(0.7), "sentiment_negative": F.lit(0.1), "time": F.lit("12:45PM")})


def test_daily_variants(spark):
    df = scored(spark)
    ref = D(2024, 3, 15)
    num = daily.daily_sentiment_numeric(df, ref)
    assert "rank" in num.columns and "time" not in num.columns
    assert rows(num, "ticker", "date", "headline_count", "rank")[0] == ("A", D(2024, 1, 1), 2, 2.0)
    assert rows(num.where("ticker='A'"), "date", "sentiment_score")[1] == (ref, -0.2)
    bare = daily.daily_sentiment_numeric(df.select("ticker", "date"), ref, default_count=5).first()
    assert bare.sentiment_score == 0.0 and bare.headline_count == 5
    dated = df.withColumn("date", F.lit("2024-01-01").cast("date"))
    out = daily.daily_sentiment(dated).where("ticker='A'").first()
    assert out.headline_count == 2 and out.sentiment_score == pytest.approx(0.4 / 3) and out.sentiment_category == "Positive"
    once, twice = daily.ensure_daily(dated), daily.ensure_daily(daily.ensure_daily(dated))
    assert rows(once, "ticker", "sentiment_score", "headline_count") == rows(twice, "ticker", "sentiment_score", "headline_count")
    assert daily.daily_sentiment_stats(dated).where("ticker='B'").first().sentiment_std is None
    assert daily.daily_sentiment_short(dated).count() == 2


def test_join_and_asof(spark):
    bars = spark.createDataFrame([("A", D(2024, 1, d), float(d)) for d in (2, 3, 8)] + [("B", D(2024, 1, 2), 1.0)], "ticker string, date date, close double")
    day = spark.createDataFrame([("A", D(2024, 1, 3), 0.5, 2), ("A", D(2024, 1, 6), -0.4, 1), ("A", D(2024, 1, 7), 0.2, 3), ("A", D(2024, 1, 9), 0.9, 1)], "ticker string, date date, sentiment_score double, headline_count bigint")
    out = joins.join_sentiment(bars, day)
    assert rows(out, "ticker", "date", "sentiment_score", "headline_count")[:3] == [("A", D(2024, 1, 2), 0.0, 0), ("A", D(2024, 1, 3), 0.5, 2), ("A", D(2024, 1, 8), 0.0, 0)]
    asof = joins.carry_sentiment_asof(bars, day)
    got = {(r.ticker, r.date.day): (r.sentiment_date, r.sentiment_score) for r in asof.collect()}
    assert got == {("A", 2): (None, None), ("A", 3): (D(2024, 1, 3), 0.5), ("A", 8): (D(2024, 1, 7), 0.2), ("B", 2): (None, None)}
    nxt = joins.next_bar_date(day, bars)
    assert rows(nxt, "date", "bar_date")[:3] == [(D(2024, 1, 3), D(2024, 1, 3)), (D(2024, 1, 6), D(2024, 1, 8)), (D(2024, 1, 7), D(2024, 1, 8))]
    moved = joins.sentiment_on_next_bar(bars, day).where("ticker='A' and date='2024-01-08'").first()
    assert moved.sentiment_score == pytest.approx((-0.4 + 0.6) / 4) and moved.headline_count == 4
    assert joins.duplicate_keys(bars).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "`Date` int, `Close_AAPL` double, `Compound` double")
    assert normalize_columns(df, ticker="AAPL").columns == ["date", "close", "sentiment_score"]
    assert pick_column(df, ("x", "Date")) == "Date"
    with pytest.raises(ValueError):
        pick_column(df, ("x",))


# --- profile --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    a = pd.DataFrame({"ticker": "A", "x": rng.normal(0, 1, 500).round(3), "y": rng.normal(0, 1, 500)})
    b = pd.DataFrame({"ticker": "B", "x": 1.5, "y": rng.normal(0, 1, 7)})
    c = pd.DataFrame({"ticker": "C", "x": np.r_[np.zeros(400), [1e9, -3.0, 2.5]], "y": 1.0})
    d = pd.DataFrame({"ticker": "D", "x": [4.25], "y": [1.0]})
    return pd.concat([a, b, c, d])


@pytest.mark.parametrize("bins,rounds", [(4096, 2), (8, 1), (5, 3)])
def test_describe(spark, sample, bins, rounds):
    df = spark.createDataFrame(sample)
    out = profile.exact_quantiles(df, "x", (0.25, 0.5, 0.75, 0.9), bins=bins, rounds=rounds)
    for r in out.collect():
        x = sample[sample.ticker == r.ticker].x
        np.testing.assert_allclose([r.p25, r.p50, r.p75, r.p90], x.quantile([0.25, 0.5, 0.75, 0.9]), rtol=1e-12)


def test_correlation_trend_histogram(spark, sample):
    df = spark.createDataFrame(sample)
    for r in profile.correlation(df, "x", "y").collect():
        g = sample[sample.ticker == r.ticker]
        if r.ticker == "A":
            assert r.correlation == pytest.approx(g.x.corr(g.y), rel=1e-9)
        else:
            assert r.correlation is None
    line = profile.ols_trend(df, "x", "y").where("ticker='A'").first()
    g = sample[sample.ticker == "A"]
    np.testing.assert_allclose([line.slope, line.intercept], np.polyfit(g.x, g.y, 1), rtol=1e-9)
    assert line.r_squared == pytest.approx(g.x.corr(g.y) ** 2)
    h = profile.histogram(df, "x")
    got = [r.frequency for r in h.where("ticker='A'").orderBy("bin").collect()]
    np.testing.assert_array_equal(got, np.histogram(g.x, 20)[0])
    flat = [r.frequency for r in h.where("ticker='B'").orderBy("bin").collect()]
    np.testing.assert_array_equal(flat, np.histogram([1.5] * 7, 20)[0])


def test_small_profiles(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 1), 1), ("A", D(2024, 1, 1), None), ("A", D(2024, 1, 2), 0)], "ticker string, date date, target int")
    q = profile.news_quality(df).first()
    assert (q.articles, q.articles_per_day, q.unique_dates) == (3, 1.5, 2)
    assert profile.null_profile(df).first().target == 1
    empty = profile.date_extent(df.where("false"), D(2024, 2, 29)).first()
    assert (empty.min_date, empty.max_date) == (D(2023, 2, 28), D(2024, 2, 29))
    dist = profile.class_distribution(df.where("target is not null"))
    assert rows(dist, "target", "rows", "share") == [(0, 1, 0.5), (1, 1, 0.5)]
    best = profile.majority_class(df.where("target is not null"), df.where("target = 0")).first()
    assert (best.majority_class, best.baseline_accuracy) == (0, 1.0)
    s = spark.createDataFrame([("A", "0.5", 0.0), ("A", "x", 0.4)], "ticker string, sentiment_positive string, sentiment_negative double")
    avg = profile.avg_sentiment(s).first()
    assert avg.avg_sentiment == pytest.approx(0.05) and avg.sentiment_class == "neutral"
    v = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "c")], "row_id int, v string")
    assert [r.v for r in profile.value_counts(v, "v", "row_id").collect()] == ["c", "b", "a"]


# --- backtest -------------------------------------------------------------------------------------


def test_backtest_golden(spark):
    data = [("A", D(2024, 1, i + 1), p, pos) for i, (p, pos) in enumerate(zip([100.0, 110.0, 99.0, 99.0], [1, 0, 1, 1]))]
    df = spark.createDataFrame(data, "ticker string, date date, close double, position int")
    out = backtest.calculate_returns(df).orderBy("date").toPandas()
    np.testing.assert_allclose(out.asset_returns[1:].astype(float), [0.1, -0.1, 0.0], atol=1e-12)
    np.testing.assert_allclose(out.strategy_cumulative.astype(float), [10000, 11000, 11000, 11000])
    assert out.asset_cumulative.isna()[0]
    np.testing.assert_allclose(out.asset_cumulative[1:].astype(float), [11000, 9900, 9900])
    np.testing.assert_allclose(out.asset_drawdown[1:].astype(float), [0, -0.1, -0.1])
    m = backtest.performance_metrics(backtest.calculate_returns(df)).first()
    assert m.total_return == pytest.approx(0.1) and m.annualized_return == pytest.approx(404.265062, abs=1e-5)
    assert m.sharpe_ratio == pytest.approx(7.912304, abs=1e-6) and m.win_rate == 1 and m.max_drawdown == 0


def test_sentiment_strategy_matches_two_steps(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2023-06-01", periods=300).date
    price = pd.DataFrame({"ticker": "A", "date": days, "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))})
    score = pd.DataFrame({"ticker": "A", "date": days[::2], "sentiment_score": rng.normal(0, 0.3, 150), "headline_count": 1})
    bars, day = spark.createDataFrame(price), spark.createDataFrame(score)
    returns, metrics = backtest.backtest_sentiment_strategy(bars, day)
    two = backtest.calculate_returns(backtest.sentiment_positions(bars, day))
    cols = ["date", "position", "actual", *backtest.SERIES]
    a = returns.select(*cols).orderBy("date").toPandas()
    b = two.select(*cols).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(a, b)
    m = price.merge(score, how="left").fillna(0)
    m["position"] = (m.sentiment_score > 0.05).astype(int)
    m = m[:-1]
    strat = (m.position.shift(1) * m.close.pct_change()).fillna(0)
    value = (1 + strat).cumprod() * 10000
    row = metrics.first()
    assert row.final_value == pytest.approx(value.iloc[-1]) and row.trading_days == 299
    assert row.max_drawdown == pytest.approx((value / value.cummax() - 1).min())
    excess = strat - (1.02 ** (1 / 252) - 1)
    assert row.sharpe_ratio == pytest.approx(math.sqrt(252) * excess.mean() / excess.std())
    assert row.true_positives + row.false_positives + row.true_negatives + row.false_negatives == 299
    long = backtest.calculate_returns(two.select("ticker", "date", "close", F.lit(1).alias("position")))
    end = long.orderBy(F.desc("date")).first()
    assert end.strategy_cumulative == pytest.approx(end.asset_cumulative)


def test_quantiles_with_an_outlier(spark):
    values = [float(i % 977) + 0.25 for i in range(4000)] + [1e18, -1e18]
    df = spark.createDataFrame([("A", v) for v in values], "ticker string, x double")
    got = profile.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.9, 1.0), bins=16, most=20).first()
    expected = [float(np.quantile(values, p)) for p in (0.0, 0.25, 0.5, 0.9, 1.0)]
    assert [got[f"p{n}"] for n in (0, 25, 50, 90, 100)] == pytest.approx(expected)


def test_histogram_leaves_out_what_is_not_finite(spark):
    rows = [("A", v) for v in (1.0, 2.0, 3.0, float("inf"), float("-inf"), float("nan"), None)] + [("B", float("inf"))]
    df = spark.createDataFrame(rows, "ticker string, x double")
    got = [(r.ticker, r.bin_start, r.frequency) for r in profile.histogram(df, "x", 2).orderBy("bin").collect()]
    assert got == [("A", 1.0, 1), ("A", 2.0, 2)]


def test_names_of_any_length(spark):
    df = spark.createDataFrame([(1, "the Bank of New York Mellon said"), (2, "Bank of New York"), (3, None)], "doc_id int, headline string")
    names = [("Bank of New York Mellon", "ORG"), ("New York", "GPE"), ("Mellon", "PERSON"), (None, "ORG"), ("Bank of Old", "ORG")]
    gaz = spark.createDataFrame(names, "entity string, entity_type string")
    got = {(r.doc_id, r.entity, r.entity_type) for r in entities.extract_entities(df, gazetteer=gaz, keep=()).collect()}
    assert got == {(1, "Bank of New York Mellon", "ORG"), (1, "New York", "GPE"), (1, "Mellon", "PERSON"), (2, "New York", "GPE")}
