"""Every operator over series gives rows without a ticker what it gives the same rows with one."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from newstape.operators import backtest, daily, joins, modeling, ordering, profile, scans, series
from newstape.sources import tables

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in (0, 1, 2, 3, 4, 7, 8, 10, 11, 14)]


def bars(spark, ticker):
    rows = [
        (ticker, day, 10.0 + i, 12.0 + i % 3, 9.0 + i, 10.0 + (7 * i) % 5 + i / 3, 100 + 13 * i) for i, day in enumerate(DAYS)
    ]
    rows += [("other", day, 5.0, 6.0, 4.0, 5.0 + i, 50) for i, day in enumerate(DAYS[:4])]
    kinds = "ticker string, date date, open double, high double, low double, close double, volume long"
    return spark.createDataFrame(rows, kinds)


def scores(spark, ticker):
    rows = [(ticker, day, 0.1 * (i % 4) - 0.1, 1 + i) for i, day in enumerate(DAYS)] + [("other", DAYS[0], 0.5, 2)]
    return spark.createDataFrame(rows, "ticker string, date date, sentiment_score double, headline_count long")


def labelled(b):
    return b.withColumn("target", (F.col("close") > 12).cast("int"))


OPERATORS = {
    "sma": lambda b, s: series.sma(b, (2, 3)),
    "rolling_mean": lambda b, s: series.rolling_mean(b, {"m": "close"}, 3),
    "rolling_std": lambda b, s: series.rolling_std(b, 3),
    "bollinger": lambda b, s: series.bollinger(b, 3),
    "rsi": lambda b, s: series.rsi(b, 3),
    "ema": lambda b, s: scans.ema(b, {"e": ("close", 3)}),
    "macd": lambda b, s: series.macd(b, 2, 4, 3),
    "add_technical_indicators": lambda b, s: series.add_technical_indicators(b),
    "pct_change": lambda b, s: series.pct_change(b),
    "diff": lambda b, s: series.diff(b),
    "shift": lambda b, s: series.shift(b, "close", 2, "before"),
    "label_next_move": lambda b, s: series.label_next_move(b),
    "create_features": lambda b, s: series.create_features(joins.join_sentiment(b, s), label=True),
    "trading_day_gaps": lambda b, s: series.trading_day_gaps(b),
    "gap_summary": lambda b, s: series.gap_summary(b),
    "news_window_bounds": lambda b, s: series.news_window_bounds(s),
    "bars_in_news_window": lambda b, s: series.bars_in_news_window(b, s),
    "cumulative_return": lambda b, s: series.cumulative_return(b.withColumn("r", F.lit(0.01)), "r"),
    "drawdown": lambda b, s: series.drawdown(b, "close"),
    "running_max": lambda b, s: scans.running_max(b, "close", "top"),
    "join_sentiment": lambda b, s: joins.join_sentiment(b, s),
    "carry_sentiment_asof": lambda b, s: joins.carry_sentiment_asof(b, s),
    "next_bar_date": lambda b, s: joins.next_bar_date(s, b),
    "sentiment_on_next_bar": lambda b, s: joins.sentiment_on_next_bar(b, s),
    "daily_sentiment_stats": lambda b, s: daily.daily_sentiment_stats(s.withColumn("sentiment_compound", F.col("sentiment_score"))),
    "correlation": lambda b, s: profile.correlation(b, "open", "close"),
    "ols_trend": lambda b, s: profile.ols_trend(b, "open", "close"),
    "histogram": lambda b, s: profile.histogram(b, "close", 4),
    "exact_quantiles": lambda b, s: profile.exact_quantiles(b, "close"),
    "describe": lambda b, s: profile.describe(b, "close"),
    "null_profile": lambda b, s: profile.null_profile(b, keys=["ticker"]),
    "class_distribution": lambda b, s: profile.class_distribution(labelled(b), keys=["ticker"]),
    "majority_class": lambda b, s: profile.majority_class(labelled(b), labelled(b)),
    "recent": lambda b, s: ordering.recent(b, 3),
    "time_split": lambda b, s: ordering.time_split(b),
    "time_series_folds": lambda b, s: ordering.time_series_folds(b, 2),
    "standardize": lambda b, s: modeling.standardize(b, ["open", "close"]),
    "prepare_data": lambda b, s: modeling.prepare_data(b, s)[0],
    "sentiment_positions": lambda b, s: backtest.sentiment_positions(b, s),
    "calculate_returns": lambda b, s: backtest.calculate_returns(b.withColumn("position", F.lit(1))),
    "sentiment_returns": lambda b, s: backtest.sentiment_returns(b, s),
    "backtest_sentiment_strategy": lambda b, s: backtest.backtest_sentiment_strategy(b, s)[1],
    "first_available": lambda b, s: tables.first_available(b.where("ticker is distinct from 'other'"), b),
}


def rows_of(df):
    columns = sorted(df.columns)
    rows = [tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in df.select(columns).collect()]
    return columns, rows


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_without_a_ticker_are_a_series(spark, name):
    run = OPERATORS[name]
    columns, named = rows_of(run(bars(spark, "x"), scores(spark, "x")))
    at = columns.index("ticker")
    wanted = [tuple(None if i == at and v == "x" else v for i, v in enumerate(row)) for row in named]
    got_columns, got = rows_of(run(bars(spark, None), scores(spark, None)))
    assert got_columns == columns and any(row[at] is None for row in got)
    assert sorted(got, key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize("run", [lambda b: profile.describe(b, "close", keys=()), lambda b: profile.histogram(b, "close", 4, keys=())])
def test_no_keys_are_one_series(spark, run):
    got = run(bars(spark, None))
    assert "ticker" not in got.columns and got.count() in (1, 4)
