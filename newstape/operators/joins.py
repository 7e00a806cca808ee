"""Joins between bars, daily sentiment and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstape.operators.blocks import COUNT, INDEX, as_keys, null_safe, position_bucket, row_index


def fill_sentiment(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """0 for missing scores and counts, ``Neutral`` for a missing category."""
    if columns is None:
        columns = [c for c in df.columns if "sentiment" in c or c in ("headline_count", "news_count")]
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    numbers = [c for c in columns if c not in texts]
    return df.na.fill(0, numbers).na.fill("Neutral", texts)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


@null_safe
def join_sentiment(
    bars: DataFrame, daily: DataFrame, keys: str | Sequence[str] = "ticker", fill: bool = True
) -> DataFrame:
    """Bars left join daily sentiment on ticker and date. Both sides hold one row per key, so no
    key can be hot; Spark picks broadcast or merge by size."""
    joined = bars.join(daily, [*as_keys(keys), "date"], "left")
    added = [c for c in daily.columns if c not in bars.columns]
    return fill_sentiment(joined, added) if fill else joined


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Keys that occur more than once: empty for tables fit for a join."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def semi_on(df: DataFrame, allowed: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``allowed``. The key side is made distinct first, so a text with
    many copies meets one row, and Spark may split its partition."""
    on = as_keys(on)
    return df.join(allowed.select(*on).distinct(), on, "left_semi")


def entities_in_range(
    entities: DataFrame, news: DataFrame, in_range: Column, link: str | Sequence[str] = "source_text"
) -> DataFrame:
    """Entities of the texts that pass the date predicate.

    A hash join: the distinct texts of the range, a share of them per task, are held, and the entity rows, of which there
    are far more, pass by without being sorted.
    """
    on = as_keys(link)
    texts = news.where(in_range).select(*on).distinct()
    return entities.join(texts.hint("shuffle_hash"), on, "left_semi")


@null_safe
def carry_sentiment_asof(
    bars: DataFrame,
    daily: DataFrame,
    columns: Sequence[str] = ("sentiment_score",),
    keys: str | Sequence[str] = "ticker",
) -> DataFrame:
    """Last known daily values on or before each bar's date (as-of join, option).

    Both tables become one ordered series; the values are carried forward by calendar buckets.
    """
    keys = as_keys(keys)
    marker = F.struct(F.col("date").alias("sentiment_date"), *[F.col(c) for c in columns])
    news_rows = daily.select(*keys, "date", F.lit(0).alias("_is_bar"), marker.alias("_seen"))
    bar_rows = bars.withColumn("_is_bar", F.lit(1))
    both = bar_rows.unionByName(news_rows, allowMissingColumns=True)
    filled = row_index(both, keys, ["date", "_is_bar"], fill=["_seen"]).where(F.col("_is_bar") == 1)
    out = filled.withColumns({c: F.col(f"_fill__seen.{c}") for c in ("sentiment_date", *columns)})
    return out.drop("_is_bar", "_seen", "_fill__seen", INDEX, COUNT)


@null_safe
def next_bar_date(
    daily: DataFrame, bars: DataFrame, keys: str | Sequence[str] = "ticker", name: str = "bar_date"
) -> DataFrame:
    """First bar date on or after each row's date, so weekend news can count for Monday.

    The series runs backwards in time; rows after the last bar get NULL.
    """
    keys = as_keys(keys)
    back = -F.unix_date("date")
    news_rows = daily.withColumns({"_order": back, "_is_news": F.lit(1), "_bar": F.lit(None).cast("date")})
    bar_rows = bars.select(
        *keys, back.alias("_order"), F.lit(0).alias("_is_news"), F.col("date").alias("_bar")
    )
    both = news_rows.unionByName(bar_rows, allowMissingColumns=True)
    bucket = position_bucket("_order", 366)
    filled = row_index(both, keys, ["_order", "_is_news"], bucket=bucket, fill=["_bar"])
    out = filled.where(F.col("_is_news") == 1).withColumn(name, F.col("_fill__bar"))
    return out.drop("_order", "_is_news", "_bar", "_fill__bar", INDEX, COUNT)


def sentiment_on_next_bar(
    bars: DataFrame, daily: DataFrame, keys: str | Sequence[str] = "ticker"
) -> DataFrame:
    """Join where news of days without a bar counts for the next bar, weighted by headlines."""
    keys = as_keys(keys)
    mapped = next_bar_date(daily, bars, keys).where(F.col("bar_date").isNotNull())
    weighted = mapped.groupBy(*keys, F.col("bar_date").alias("date")).agg(
        F.try_divide(F.sum(F.col("sentiment_score") * F.col("headline_count")), F.sum("headline_count")).alias(
            "sentiment_score"
        ),
        F.sum("headline_count").alias("headline_count"),
    )
    return join_sentiment(bars, weighted, keys)
