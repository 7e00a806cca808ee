"""The batch operators on streams of headlines and ticks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from newstape.functions.text import sentiment_category
from newstape.operators.blocks import forward_fill, over_blocks
from newstape.operators.joins import fill_sentiment
from newstape.operators.sentiment import score_news
from newstape.operators.series import tick_order
from newstape.schema import NEWS, TICKS


def stream_files(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    name_filter: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """New files as rows. ``spread`` deals the rows of each micro-batch out to that many tasks, for
    heavy work on few large files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.load(path)
    return rows.repartition(spread) if spread else rows


def table_glob(folder: str, name: str) -> str:
    """Path for ``stream_files`` of a stored table, be it one file or a folder of part files.

    A stream takes a plain path for a folder, and filters by name see only the last part of it; a pattern
    with one choice finds either.
    """
    return f"{folder}/{{{name}}}"


def stream_news(spark: SparkSession, path: str, schema: str = f"{NEWS}, ts timestamp", **kw) -> DataFrame:
    return stream_files(spark, path, schema, **kw)


def stream_ticks(spark: SparkSession, path: str, schema: str = TICKS, **kw) -> DataFrame:
    return stream_files(spark, path, schema, **kw)


def stream_scores(
    news: DataFrame, lexicon: dict[str, float] | None = None, finance: bool = True, text: str = "headline"
) -> DataFrame:
    """Stateless scoring, row by row."""
    return score_news(news, lexicon, finance, text)


def stream_dedup(
    news: DataFrame,
    keys: Sequence[str] = ("ticker", "headline"),
    delay: str = "1 day",
    ts: str = "ts",
    salts: int = 32,
) -> DataFrame:
    """One row per key within the watermark delay; state is dropped behind it.

    Deduplication shuffles every row, so a headline with very many copies would meet in one task.
    With ``salts`` > 1 copies are first removed per (key, slot of the input task), which spreads them
    over that many tasks; what is left is at most ``salts`` rows per key.
    """
    marked = news.withWatermark(ts, delay)
    if salts > 1:
        marked = (
            marked.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
            .dropDuplicatesWithinWatermark([*keys, "_salt"])
            .drop("_salt")
        )
    return marked.dropDuplicatesWithinWatermark(list(keys))


def stream_daily_sentiment(
    scored: DataFrame, delay: str = "1 day", size: str = "1 day", slide: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Daily means on event time (tumbling, or sliding with ``slide``); partial sums per task."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    daily = (
        scored.withWatermark(ts, delay)
        .groupBy("ticker", span.alias("_w"))
        .agg(
            F.avg("sentiment_compound").alias("sentiment_score"),
            F.count("headline").alias("headline_count"),
        )
    )
    return daily.select(
        "ticker",
        F.col("_w.start").cast("date").alias("date"),
        "sentiment_score",
        "headline_count",
        sentiment_category("sentiment_score").alias("sentiment_category"),
    )


def day_panes(scored: DataFrame, ts: str | None = None, delay: str = "1 day") -> DataFrame:
    """Sum and count of the scores and number of headlines per ticker and day: what any window of whole days is made of.

    On a stream (``ts``) the days are kept until the watermark has passed them; in batch ``date`` is the day.
    """
    rows = scored.withWatermark(ts, delay) if ts else scored
    day = F.window(ts, "1 day").alias("_w") if ts else F.col("date")
    panes = rows.groupBy("ticker", day).agg(
        F.sum("sentiment_compound").alias("_sum"), F.count("sentiment_compound").alias("_n"), F.count("headline").alias("_headlines")
    )
    return panes.withColumn("date", F.col("_w.start").cast("date")).drop("_w") if ts else panes


def windows_of_panes(panes: DataFrame, days: int = 7) -> DataFrame:
    """Means of every window of ``days`` days that holds a headline, by its first day (``date``).

    Only panes are copied, one row per ticker and day, never headlines.
    """
    starts = F.sequence(F.date_sub("date", days - 1), F.col("date"))
    spread = panes.select("ticker", F.explode(starts).alias("date"), "_sum", "_n", "_headlines")
    return spread.groupBy("ticker", "date").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("sentiment_score"), F.sum("_headlines").alias("headline_count")
    )


def window_sentiment(scored: DataFrame, days: int = 7) -> DataFrame:
    """The sliding window as a batch report."""
    return windows_of_panes(day_panes(scored), days)


def stream_window_sentiment(scored: DataFrame, out: str, days: int = 7, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """The sliding window over a stream: it stores day panes (update mode), windows are made from the stored ones."""
    return windows_of_panes(run_once(day_panes(scored, ts, delay), out, "update", ["ticker", "date"]), days)


def stream_join_streams(bars: DataFrame, scored: DataFrame, delay: str = "1 day", news_delay: str | None = None, ts: str = "ts") -> DataFrame:
    """Streamed bars with the streamed headlines of their day: one row per bar, with 0 where there is no news.

    Both sides wait in state until the watermark, the older of the two, has passed their day; then bars come out, matched
    or not, and the state goes. Rows that come later than that are left out on either side.
    """
    daily = (
        scored.withWatermark(ts, news_delay or delay)
        .groupBy(F.col("ticker").alias("_ticker"), F.window(ts, "1 day").alias("_day"))
        .agg(F.avg("sentiment_compound").alias("sentiment_score"), F.count("headline").alias("headline_count"))
    )
    dated = bars.withWatermark(ts, delay).withColumn("_w", F.window(ts, "1 day"))
    same = F.col("ticker").eqNullSafe(F.col("_ticker")) & (F.col("_w") == F.col("_day"))
    joined = dated.join(daily, same, "left_outer")
    kept = [c for c in bars.columns if c != ts]
    added = ["sentiment_score", "headline_count"]
    return fill_sentiment(joined.select(*kept, F.col("_w.start").cast("date").alias("date"), *added), added)


def stream_bars(ticks: DataFrame, interval: str = "1 day", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Open / high / low / close / volume per interval of event time."""
    at = tick_order(ts)
    grouped = ticks.withWatermark(ts, delay).groupBy("ticker", F.window(ts, interval).alias("_w"))
    return grouped.agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    ).select("ticker", F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def stream_join_bars(daily: DataFrame, bars: DataFrame) -> DataFrame:
    """Streamed daily sentiment with the stored bars of the day, if any."""
    return daily.join(bars, ["ticker", "date"], "left")


def bars_with_streamed_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Bars left join what the stream has written so far."""
    added = [c for c in daily.columns if c not in bars.columns]
    return fill_sentiment(bars.join(daily, ["ticker", "date"], "left"), added)


def burst_sessions_stream(
    events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """Bursts per ticker: events at most ``gap`` apart; a burst is written once the watermark has passed it.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` (``local_session``
    does) so that sessions are merged inside a task before the shuffle.
    """
    grouped = events.withWatermark(ts, delay).groupBy("ticker", F.session_window(ts, gap).alias("_w"))
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        "ticker", F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "events"
    )


def burst_slots(events: DataFrame, gap_minutes: int = 30, ts: str = "ts") -> DataFrame:
    """First and last time and count of the events of each gap-wide slot. Events of one slot always
    belong to one burst, so this partial aggregation (batch or stream) bounds the rows by the calendar."""
    slots = events.groupBy("ticker", F.window(ts, f"{gap_minutes} minutes").alias("_w")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    return slots.select("ticker", F.col("_w.start").alias("_slot"), "_from", "_to", "_n")


def bursts_of_slots(slots: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Bursts as runs of slots, on blocks: no task owns a ticker."""
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))

    def starts(x: DataFrame, w: WindowSpec) -> DataFrame:
        apart = F.coalesce(F.lag("_to").over(w) + gap < F.col("_from"), F.lit(True))
        return x.withColumn("_start", F.when(apart, F.col("_from")))

    marked = over_blocks(slots, starts, back=1, order="_from")
    runs = forward_fill(marked, ["_start"], order="_from")
    return runs.groupBy("ticker", F.col("_start").alias("session_start")).agg(
        (F.max("_to") + gap).alias("session_end"), F.sum("_n").alias("events")
    )


def burst_sessions(events: DataFrame, gap_minutes: int = 30, ts: str = "ts") -> DataFrame:
    """Bursts per ticker in batch: events at most ``gap_minutes`` apart."""
    return bursts_of_slots(burst_slots(events, gap_minutes, ts), gap_minutes)


def stream_bursts(
    events: DataFrame, out: str, gap_minutes: int = 30, delay: str = "1 hour", ts: str = "ts"
) -> DataFrame:
    """Run the stream over what is there and return all bursts, those still open included.

    The stream keeps slots (update mode, state dropped behind the watermark); bursts are made from
    the stored slots, so a burst that goes on after this run grows with the next one.
    """
    slots = burst_slots(events.withWatermark(ts, delay), gap_minutes, ts)
    return bursts_of_slots(run_once(slots, out, "update", ["ticker", "_slot"]), gap_minutes)


def run_once(
    stream: DataFrame,
    out: str,
    mode: str = "append",
    keys: Sequence[str] = (),
    on_batch: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Process what is there (AvailableNow) and return the written result.

    Each micro-batch replaces its own folder, so a repeated batch does not double rows. In update
    mode the newest version of every key is returned. ``out`` must be a shared folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        result = on_batch(batch, batch_id) if on_batch else batch
        result.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = stream.sparkSession.read.parquet(f"{out}/rows")
    return latest(written, keys) if mode == "update" and keys else written.drop("batch")


def latest(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key among the update batches."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}") for c in rest])
