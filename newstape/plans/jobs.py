"""Whole jobs over all tickers at once: one lazy plan per written table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from newstape.functions.dates import fix_dates
from newstape.operators.daily import daily_sentiment
from newstape.operators.entities import extract_entities
from newstape.operators.joins import join_sentiment
from newstape.operators.sentiment import score_news, score_news_light
from newstape.operators.series import INDICATORS, add_technical_indicators, create_features
from newstape.sources.tables import write_table


@dataclass
class JobConfig:
    out_dir: str
    ref_date: dt.date
    lexicon: dict[str, float] = field(default_factory=dict)
    finance: bool = True
    light: bool = False
    indicators: tuple[str, ...] = INDICATORS
    key: str = "doc_id"
    partition_by: tuple[str, ...] = ("ticker",)


def scored_news(news: DataFrame, config: JobConfig) -> DataFrame:
    dated = news if dict(news.dtypes)["date"] == "date" else news.withColumn("date", fix_dates("date", config.ref_date))
    if config.light:
        return score_news_light(dated, config.lexicon)
    return score_news(dated, config.lexicon, config.finance)


def process_news(news: DataFrame, config: JobConfig) -> DataFrame:
    """Score headlines, store them, return the daily table built from what was stored."""
    spark = news.sparkSession
    path = f"{config.out_dir}/scored_news"
    write_table(scored_news(news, config), path, config.partition_by)
    return daily_sentiment(spark.read.parquet(path))


def run_daily_job(
    spark: SparkSession,
    bars: DataFrame,
    news: DataFrame,
    config: JobConfig,
    gazetteer: DataFrame | None = None,
) -> dict[str, str]:
    """Score, aggregate, extract entities, compute indicators and features; returns table paths.

    Later tables read the stored earlier ones, so a lost executor repeats one stage and not the
    whole chain.
    """
    paths = {
        name: f"{config.out_dir}/{name}"
        for name in ("scored_news", "daily_sentiment", "entities", "bars", "features")
    }
    write_table(process_news(news, config), paths["daily_sentiment"], config.partition_by)
    keep = tuple(c for c in ("ticker", "date") if c in news.columns)
    found = extract_entities(news, config.key, gazetteer=gazetteer, keep=keep)
    write_table(found, paths["entities"], config.partition_by)
    write_table(add_technical_indicators(bars, config.indicators), paths["bars"], config.partition_by)
    stored_bars = spark.read.parquet(paths["bars"])
    daily = spark.read.parquet(paths["daily_sentiment"])
    features = create_features(join_sentiment(stored_bars, daily), label=True)
    write_table(features, paths["features"], config.partition_by)
    return paths
