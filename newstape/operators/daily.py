"""Daily sentiment per ticker."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstape.functions.dates import fix_dates
from newstape.functions.text import sentiment_category
from newstape.operators.blocks import as_keys

# Columns that never count as numbers (fixed values).
NOT_NUMERIC = ("sentiment_category", "time", "headline", "cleaned_text", "ticker")


def daily_sentiment(scored: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """Mean scores, their spread, the number of headlines and the class of the mean score."""
    daily = scored.groupBy(*as_keys(keys), "date").agg(
        F.avg("sentiment_compound").alias("sentiment_score"),
        F.avg("sentiment_positive").alias("sentiment_positive"),
        F.avg("sentiment_neutral").alias("sentiment_neutral"),
        F.avg("sentiment_negative").alias("sentiment_negative"),
        F.stddev_samp("sentiment_compound").alias("sentiment_std"),
        F.count("headline").alias("headline_count"),
    )
    return daily.withColumn("sentiment_category", sentiment_category("sentiment_score"))


def daily_sentiment_short(scored: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """The four mean scores under ``*_score`` names and the number of rows."""
    return scored.groupBy(*as_keys(keys), "date").agg(
        F.avg("sentiment_compound").alias("compound_score"),
        F.avg("sentiment_positive").alias("positive_score"),
        F.avg("sentiment_neutral").alias("neutral_score"),
        F.avg("sentiment_negative").alias("negative_score"),
        F.count("sentiment_compound").alias("headline_count"),
    )


def daily_sentiment_stats(scored: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """Mean, count and sample deviation of the score (NULL deviation for a single headline)."""
    return scored.groupBy(*as_keys(keys), "date").agg(
        F.avg("sentiment_compound").alias("sentiment_score"),
        F.count("sentiment_compound").alias("news_count"),
        F.stddev_samp("sentiment_compound").alias("sentiment_std"),
    )


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Number columns plus text columns in which every value converts (one aggregate row is read)."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if texts:
        bad = df.agg(
            *[
                F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
                for c in texts
            ]
        ).first()
        numbers += [c for c in texts if bad[c] == 0]
    return [c for c in df.columns if c in numbers]


def daily_sentiment_numeric(
    scored: DataFrame,
    ref: Column | dt.date,
    keys: str | Sequence[str] = "ticker",
    default_count: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Mean of every numeric column per day after settling the dates.

    ``columns`` skips the look at text columns, the only ones whose values must be seen. Missing
    score -> 0, missing headlines -> ``default_count``.
    """
    keys = as_keys(keys)
    skip = [*NOT_NUMERIC, *keys, "date"]
    names = list(columns) if columns is not None else numeric_columns(scored, skip)
    aggregates = [F.avg(F.col(c).try_cast("double")).alias(c) for c in names]
    if "headline" in scored.columns:
        aggregates.append(F.count("headline").alias("headline_count"))
    dated = scored.withColumn("date", fix_dates("date", ref))
    daily = dated.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_rows"), *aggregates).drop("_rows")
    for source in ("sentiment_compound", "compound"):
        if source in daily.columns and "sentiment_score" not in daily.columns:
            daily = daily.withColumnRenamed(source, "sentiment_score")
    if "sentiment_score" not in daily.columns:
        daily = daily.withColumn("sentiment_score", F.lit(0.0))
    if "headline_count" not in daily.columns:
        daily = daily.withColumn("headline_count", F.lit(default_count).cast("bigint"))
    return daily


def ensure_daily(sentiment: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """One row per ticker and day, whether the input is scored headlines or already daily.

    Averaging a daily table changes nothing, so no look at row counts is needed.
    """
    score = "sentiment_score" if "sentiment_score" in sentiment.columns else "sentiment_compound"
    parts = [c for c in ("sentiment_positive", "sentiment_neutral", "sentiment_negative") if c in sentiment.columns]
    if "headline_count" in sentiment.columns:
        count = F.sum("headline_count")
    else:
        count = F.count("headline" if "headline" in sentiment.columns else score)
    daily = sentiment.groupBy(*as_keys(keys), "date").agg(
        F.avg(score).alias("sentiment_score"),
        *[F.avg(c).alias(c) for c in parts],
        count.cast("bigint").alias("headline_count"),
    )
    return daily.withColumn("sentiment_category", sentiment_category("sentiment_score"))
