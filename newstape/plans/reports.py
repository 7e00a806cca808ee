"""The data behind each report widget."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstape.functions.dates import in_date_range
from newstape.functions.display import display_bars, display_sentiment, score_text
from newstape.operators.joins import join_sentiment
from newstape.operators.ordering import recent
from newstape.operators.profile import avg_sentiment, correlation, date_extent, histogram, ols_trend
from newstape.operators.series import pct_change, rolling_mean

Date = dt.date | None


def _clip(df: DataFrame, start: Date, end: Date) -> DataFrame:
    return df.where(in_date_range("date", start, end)) if start or end else df


def price_sentiment_series(bars: DataFrame, daily: DataFrame, start: Date = None, end: Date = None) -> DataFrame:
    """Bars with the day's score and headline count; the range reaches both scans."""
    columns = [c for c in ("sentiment_score", "headline_count") if c in daily.columns]
    return join_sentiment(_clip(bars, start, end), _clip(daily, start, end).select("ticker", "date", *columns))


def correlation_points(
    bars: DataFrame, daily: DataFrame, start: Date = None, end: Date = None, size: int | None = None
) -> DataFrame:
    """Date, score and price change. The range is cut before the change is taken, so its first row
    has none and drops out."""
    joined = price_sentiment_series(bars, daily, start, end)
    changed = pct_change(joined, "close", "price_change", **({"size": size} if size else {}))
    return changed.where(F.col("price_change").isNotNull()).select(
        "ticker", "date", "sentiment_score", "price_change"
    )


def correlation_summary(points: DataFrame) -> DataFrame:
    """Pearson correlation and trend line per ticker."""
    trend = ols_trend(points, "sentiment_score", "price_change").drop("points")
    return correlation(points, "sentiment_score", "price_change").join(trend, "ticker")


def recent_bars(bars: DataFrame, n: int = 10, start: Date = None, end: Date = None) -> DataFrame:
    return display_bars(recent(_clip(bars, start, end), n))


def recent_sentiment(daily: DataFrame, n: int = 10, start: Date = None, end: Date = None) -> DataFrame:
    return display_sentiment(recent(_clip(daily, start, end), n))


def summary_card(
    daily: DataFrame, bars: DataFrame, ref: dt.date, start: Date = None, end: Date = None
) -> DataFrame:
    """Range text, mean score and its class per ticker. A missing bound comes from the bars; a ticker
    without rows in the range shows ``N/A``."""
    in_range = in_date_range("date", start, end) if start or end else None
    known = daily.select("ticker").distinct()
    card = known.join(avg_sentiment(daily, in_range), "ticker", "left").na.fill(
        {"sentiment_class": "neutral", "rows_in_range": 0}
    )
    extent = date_extent(bars, ref).select(
        (F.lit(start).cast("date") if start else F.col("min_date")).alias("_from"),
        (F.lit(end).cast("date") if end else F.col("max_date")).alias("_to"),
        F.lit(1).alias("_one"),
    )
    text = F.concat(F.date_format("_from", "MMM dd, yyyy"), F.lit(" - "), F.date_format("_to", "MMM dd, yyyy"))
    return (
        card.withColumn("_one", F.lit(1))
        .join(F.broadcast(extent), "_one")  # one row
        .select(
            "ticker",
            text.alias("date_range"),
            score_text("avg_sentiment").alias("avg_sentiment"),
            "sentiment_class",
            "rows_in_range",
        )
    )


def rolling_overview(bars: DataFrame, daily: DataFrame, n: int = 5) -> DataFrame:
    joined = price_sentiment_series(bars, daily)
    columns = {"sentiment_rolling": "sentiment_score", "close_rolling": "close"}
    return rolling_mean(joined, columns, n).select("ticker", "date", *columns)


def daily_sentiment_histogram(bars: DataFrame, daily: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(price_sentiment_series(bars, daily), "sentiment_score", bins)
