"""Exponential averages that go on from batch to batch, in two ways.

``stream_ema``: the state is one row per ticker and lives as a small table next to the results. A
micro-batch is averaged with the block scan, which no hot ticker can overload, and the carried value
is added afterwards: ``y[i] = local[i] + decay**(i+1) * carry``. Every tick has its average at once.

``stream_carries``: the state lives in Spark's state store. Ticks are summed up per ticker and slot of
time, spread over all tasks; once the watermark has passed a slot, its one summary row goes to
the ticker's stateful processor, which gives the average that the slot starts from.
``averages_of_slots`` adds it to the ticks of the slot.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newstape.operators.blocks import BLOCK, COUNT, INDEX, NULL_KEY, OWN, as_keys, blocks, fill_keys, restore_keys, row_index
from newstape.operators.scans import decay_of, decayed_sums
from newstape.session import drop_folder
from newstape.streaming.jobs import run_once


def continue_ema(
    batch: DataFrame,
    state: DataFrame | None,
    spans: dict[str, float],
    column: str = "price",
    keys: str | Sequence[str] = "ticker",
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """Averages of a batch given the last averages per ticker; a new ticker starts at its first
    price."""
    keys = as_keys(keys)
    names = list(spans)
    indexed = row_index(batch.where(F.col(column).isNotNull()), keys, order)
    if state is None:
        carried = indexed.withColumns({f"_last_{n}": F.lit(None).cast("double") for n in names})
    else:
        last = state.select(*keys, *[F.col(n).alias(f"_last_{n}") for n in names])
        carried = indexed.join(last, keys, "left")
    starts = (F.col(INDEX) == 0) & F.col(f"_last_{names[0]}").isNull()
    sums = {
        n: (
            F.when(starts, F.col(column)).otherwise(F.col(column) * F.lit(1.0 - decay_of(span))),
            decay_of(span),
        )
        for n, span in spans.items()
    }
    local = decayed_sums(blocks(carried), sums, keys)
    total = {
        n: F.col(n)
        + F.pow(F.lit(decay_of(span)), F.col(INDEX) + 1) * F.coalesce(f"_last_{n}", F.lit(0.0))
        for n, span in spans.items()
    }
    return local.withColumns(total).drop(BLOCK, OWN, COUNT, *[f"_last_{n}" for n in names])


def last_values(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Last averages per ticker; the newest state first looks at the batch, then at the old state."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), INDEX).alias("_s")).select(
        *keys, *[F.col(f"_s.{n}").alias(n) for n in names]
    )


def stream_ema(
    ticks: DataFrame,
    out: str,
    spans: dict[str, float],
    column: str = "price",
    keys: str | Sequence[str] = "ticker",
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """Run the stream over what is there; rows must arrive in order from batch to batch.

    The state tables of the last two batches are kept, so a repeated batch starts from the same state.
    """
    keys = as_keys(keys)
    names = list(spans)
    spark = ticks.sparkSession

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        session = batch.sparkSession
        state = session.read.parquet(f"{out}/state/{batch_id - 1}") if batch_id > 0 else None
        path = f"{out}/averaged/{batch_id}"
        continue_ema(batch, state, spans, column, keys, order).write.mode("overwrite").parquet(path)
        rows = session.read.parquet(path)
        fresh = last_values(rows, names, keys)
        if state is not None:
            fresh = fresh.unionByName(state.join(fresh.select(*keys), keys, "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{out}/state/{batch_id}")
        if batch_id > 1:  # a repeated batch needs the state before it, nothing older
            drop_folder(session, f"{out}/state/{batch_id - 2}")
            drop_folder(session, f"{out}/averaged/{batch_id - 2}")
        return rows.drop(INDEX)

    run_once(ticks, out, on_batch=step)
    return spark.read.parquet(f"{out}/rows").drop("batch")


#: The state store that processors with several state variables need.
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def slot_summaries(
    ticks: DataFrame, spans: dict[str, float], slot: str = "1 minute", delay: str = "1 hour", column: str = "price"
) -> DataFrame:
    """Per ticker and slot: number of ticks, first price, and for each span the average at the end if it began at 0.

    Ticks without a price are stepped over. A slot's ticks are ordered in one row, so slots should be short.
    """
    kept = ticks.withWatermark("ts", delay).where(F.col(column).isNotNull())
    tick = F.struct("ts", "event_id", F.col(column).cast("double").alias("_x"))
    slots = kept.groupBy("ticker", F.window("ts", slot).alias("_w")).agg(F.array_sort(F.collect_list(tick)).alias("_ticks"))

    def end(span: float):
        decay = decay_of(span)
        return F.aggregate("_ticks", F.lit(0.0), lambda y, t: y * F.lit(decay) + t["_x"] * F.lit(1.0 - decay))

    return slots.select(
        F.coalesce("ticker", F.lit(NULL_KEY)).alias("ticker"),
        F.col("_w.start").alias("slot"),
        F.size("_ticks").cast("long").alias("ticks"),
        F.get("_ticks", F.lit(0))["_x"].alias("first"),
        F.array(*[end(span) for span in spans.values()]).alias("ends"),
    )


class Carry(StatefulProcessor):
    """Keeps a ticker's last averages; gives each slot the averages it starts from, a first slot its first price."""

    def __init__(self, decays: list[float]):
        self.decays = decays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots = pd.concat(list(rows)).sort_values("slot")
        known = list(self.last.get()[0]) if self.last.exists() else None
        carries = []
        for row in slots.itertuples():
            known = known or [row.first] * len(self.decays)
            carries.append(known)
            known = [end + decay**row.ticks * y for end, decay, y in zip(row.ends, self.decays, known)]
        self.last.update((known,))
        yield pd.DataFrame({"ticker": key[0], "slot": slots["slot"].to_numpy(), "carries": carries})

    def close(self) -> None:
        pass


def stream_carries(
    ticks: DataFrame, out: str, spans: dict[str, float], slot: str = "1 minute", delay: str = "1 hour", column: str = "price"
) -> DataFrame:
    """Run the stream over what is there; (ticker, slot, one column per span) of all slots behind the watermark so far.

    State and progress are in the checkpoint below ``out``, so a later run goes on where this one ended.
    """
    spark = ticks.sparkSession
    processor = Carry([decay_of(s) for s in spans.values()])
    shape = "ticker string, slot timestamp, carries array<double>"
    carried = slot_summaries(ticks, spans, slot, delay, column).groupBy("ticker").transformWithStateInPandas(
        processor, outputStructType=shape, outputMode="Append", timeMode="None"
    )
    before = spark.conf.get(STORE_CONF)
    spark.conf.set(STORE_CONF, ROCKSDB)
    try:
        stored = run_once(carried, out)
    finally:
        spark.conf.set(STORE_CONF, before)
    named = [F.get("carries", F.lit(i)).alias(name) for i, name in enumerate(spans)]
    return stored.select(F.nullif("ticker", F.lit(NULL_KEY)).alias("ticker"), "slot", *named)


def averages_of_slots(
    ticks: DataFrame, carries: DataFrame, spans: dict[str, float], slot: str = "1 minute", column: str = "price"
) -> DataFrame:
    """The ticks of all slots that have a carry, with their averages."""
    rows = fill_keys(ticks.where(F.col(column).isNotNull()), "ticker").withColumn("slot", F.window("ts", slot)["start"])
    known = fill_keys(carries, "ticker")
    rows = rows.join(known.select("ticker", "slot"), ["ticker", "slot"], "left_semi")
    return restore_keys(continue_ema(rows, known, spans, column, ["ticker", "slot"]).drop(INDEX, "slot"), "ticker")
