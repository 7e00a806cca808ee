"""Indicators, changes, labels and calendars over price series."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newstape.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    COUNT,
    INDEX,
    OWN,
    as_keys,
    block_window,
    blocks,
    null_safe,
    over_blocks,
    row_index,
)
from newstape.operators.scans import compounded, decay_of, decayed_sums, running_max

# Rates closer than this lose too many digits in the one-pass form of the signal.
NEAR_DECAYS = 0.02
INDICATORS = ("SMA20", "SMA50", "RSI14", "MACD", "BB")


# --- column builders over one shared window: Catalyst evaluates them with a single sort ---------


def _last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def _when_full(value: Column, source: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(source).over(_last_rows(w, n)) == n, value)


def sma_over(source: Column, n: int, w: WindowSpec) -> Column:
    return _when_full(F.avg(source).over(_last_rows(w, n)), source, w, n)


def std_over(source: Column, n: int, w: WindowSpec) -> Column:
    return _when_full(F.stddev_samp(source).over(_last_rows(w, n)), source, w, n)


def rolling_mean_over(source: Column, n: int, w: WindowSpec) -> Column:
    return F.avg(source).over(_last_rows(w, n))


def _change(x: DataFrame, w: WindowSpec, column: str) -> DataFrame:
    return x.withColumn("_chg", F.col(column) - F.lag(column).over(w))


def rsi_over(n: int, w: WindowSpec) -> Column:
    """Plain-mean RSI from the change column ``_chg``; a missing change counts as 0."""
    change = F.coalesce(F.col("_chg"), F.lit(0.0))
    frame = _last_rows(w, n)
    gain = F.avg(F.greatest(change, F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-change, F.lit(0.0))).over(frame)
    full = F.count(F.lit(1)).over(frame) == n
    value = (
        F.when((loss == 0) & (gain == 0), F.lit(None))
        .when(loss == 0, F.lit(100.0))
        .otherwise(100.0 - F.try_divide(F.lit(100.0), 1.0 + F.try_divide(gain, loss)))
    )
    return F.when(full, value)


# --- operators -----------------------------------------------------------------------------------


def sma(df: DataFrame, periods: Sequence[int] = (20, 50), column: str = "close", **kw) -> DataFrame:
    return over_blocks(
        df,
        lambda x, w: x.withColumns({f"sma{n}": sma_over(F.col(column), n, w) for n in periods}),
        back=max(periods) - 1,
        **kw,
    )


def rolling_mean(df: DataFrame, columns: dict[str, str], n: int, **kw) -> DataFrame:
    """``name -> column``: mean of up to n rows, from the first row on."""
    return over_blocks(
        df,
        lambda x, w: x.withColumns(
            {name: rolling_mean_over(F.col(c), n, w) for name, c in columns.items()}
        ),
        back=n - 1,
        **kw,
    )


def rolling_std(df: DataFrame, n: int = 20, column: str = "close", **kw) -> DataFrame:
    return over_blocks(
        df, lambda x, w: x.withColumn(f"std{n}", std_over(F.col(column), n, w)), back=n - 1, **kw
    )


def _bands(x: DataFrame, w: WindowSpec, n: int, width: float, column: str) -> DataFrame:
    source = F.col(column)
    x = x.withColumns({"bb_middle": sma_over(source, n, w), "bb_std": std_over(source, n, w)})
    return x.withColumns(
        {
            "bb_upper": F.col("bb_middle") + F.col("bb_std") * F.lit(width),
            "bb_lower": F.col("bb_middle") - F.col("bb_std") * F.lit(width),
        }
    )


def bollinger(
    df: DataFrame, n: int = 20, width: float = 2.0, column: str = "close", **kw
) -> DataFrame:
    return over_blocks(df, lambda x, w: _bands(x, w, n, width, column), back=n - 1, **kw)


def rsi(df: DataFrame, n: int = 14, column: str = "close", **kw) -> DataFrame:
    return over_blocks(
        df,
        lambda x, w: _change(x, w, column).withColumn(f"rsi{n}", rsi_over(n, w)).drop("_chg"),
        back=n,
        **kw,
    )


@null_safe
def macd(
    df: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    column: str = "close",
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    size: int = BLOCK_ROWS,
    keep_ema: bool = False,
) -> DataFrame:
    """``macd``, ``macd_signal``, ``macd_hist`` from one scan.

    The signal is an exponential average of two others. Two first-order filters in a row equal a
    weighted difference of the single filters, so the scan only keeps decayed sums of the price at
    the three rates plus the fading first price; no second pass over the rows is needed. Where two
    rates are (nearly) equal that difference has no (or few) digits: the signal is then scanned from
    the line itself.
    """
    keys = as_keys(keys)
    marked = df.withColumn("_gap", F.col(column).isNull())
    series = [*keys, "_gap"]
    indexed = blocks(row_index(marked, series, order, first=[column]), size=size)
    out = _macd_columns(indexed, fast, slow, signal, column, series, size)
    extra = [] if keep_ema else [f"ema{fast}", f"ema{slow}"]
    return out.drop("_gap", BLOCK, OWN, INDEX, COUNT, f"_first_{column}", *extra)


def _macd_columns(
    df: DataFrame, fast: int, slow: int, signal: int, column: str, series: list[str], size: int
) -> DataFrame:
    price, start = F.col(column), F.col(INDEX) == 0
    bs, as_ = decay_of(signal), 1.0 - decay_of(signal)
    weighted = {
        span: F.when(start, price).otherwise(price * F.lit(1.0 - decay_of(span)))
        for span in (fast, slow)
    }
    sums = {f"ema{span}": (weighted[span], decay_of(span)) for span in (fast, slow)}
    if min(abs(decay_of(span) - bs) for span in (fast, slow)) < NEAR_DECAYS:
        out = decayed_sums(df, sums, series, size)
        out = out.withColumn("macd", F.col(f"ema{fast}") - F.col(f"ema{slow}"))
        line = F.when(start, F.col("macd")).otherwise(F.col("macd") * F.lit(as_))
        out = decayed_sums(out, {"macd_signal": (line, bs)}, series, size)
        return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    sums["_past"] = (F.when(start, F.lit(0.0)).otherwise(price), bs)
    out = decayed_sums(df, sums, series, size)
    faded = F.pow(F.lit(bs), F.col(INDEX)) * F.col(f"_first_{column}")

    def smoothed(span: int) -> Column:
        b = decay_of(span)
        a = 1.0 - b
        pushed = F.col("_past") + faded / F.lit(a)
        cascade = (F.lit(bs) * pushed - F.lit(b / a) * F.col(f"ema{span}")) * F.lit(
            a * as_ / (bs - b)
        )
        return cascade + F.lit(bs) * faded

    out = out.withColumn("macd", F.col(f"ema{fast}") - F.col(f"ema{slow}"))
    out = out.withColumn("macd_signal", smoothed(fast) - smoothed(slow))
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_past")


def add_technical_indicators(
    df: DataFrame,
    selected: Sequence[str] = INDICATORS,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """The chosen subset of SMA20, SMA50, RSI14, MACD and BB as extra columns of the bars."""
    unknown = set(selected) - set(INDICATORS)
    if unknown:
        raise ValueError(f"unknown indicators {sorted(unknown)}")

    def body(x: DataFrame, w: WindowSpec) -> DataFrame:
        close = F.col("close")
        averages = {
            f"sma{n}": sma_over(close, n, w) for n in (20, 50) if f"SMA{n}" in selected
        }
        if averages:
            x = x.withColumns(averages)
        if "RSI14" in selected:
            x = _change(x, w, "close").withColumn("rsi14", rsi_over(14, w)).drop("_chg")
        if "BB" in selected:
            x = _bands(x, w, 20, 2.0, "close")
        return x

    reach = max([{"SMA20": 19, "SMA50": 49, "RSI14": 14, "BB": 19}.get(s, 0) for s in selected] + [0])
    if "MACD" in selected:
        df = macd(df, keys=keys, order=order, size=size)
    return over_blocks(df, body, back=reach, keys=keys, order=order, size=size) if reach else df


def pct_change(
    df: DataFrame,
    column: str = "close",
    name: str | None = None,
    n: int = 1,
    **kw,
) -> DataFrame:
    """``x / x[n rows back] - 1`` on the forward-filled series; a zero base gives NULL."""
    filled = F.col(f"_fill_{column}")

    def body(x: DataFrame, w: WindowSpec) -> DataFrame:
        return x.withColumn(name or f"{column}_pct", F.try_divide(filled, F.lag(filled, n).over(w)) - 1)

    return over_blocks(df, body, back=n, fill=[column], **kw)


def diff(df: DataFrame, column: str = "close", n: int = 1, name: str | None = None, **kw) -> DataFrame:
    name = name or f"{column}_diff"
    return over_blocks(
        df,
        lambda x, w: x.withColumn(name, F.col(column) - F.lag(column, n).over(w)),
        back=n,
        **kw,
    )


def shift(df: DataFrame, column: str, n: int, name: str, **kw) -> DataFrame:
    """Value n rows back (n > 0) or ahead (n < 0)."""
    move = (lambda w: F.lag(column, n).over(w)) if n >= 0 else (lambda w: F.lead(column, -n).over(w))
    return over_blocks(
        df, lambda x, w: x.withColumn(name, move(w)), back=max(n, 0), ahead=max(-n, 0), **kw
    )


def label_next_move(
    df: DataFrame, n: int = 1, column: str = "close", keep_last: bool = False, **kw
) -> DataFrame:
    """``price_change`` n rows ahead and ``target`` (1 = up).

    The last n rows have no change: dropped by default, kept with target 0 if ``keep_last``.
    """

    def body(x: DataFrame, w: WindowSpec) -> DataFrame:
        return x.withColumn("price_change", F.lead(column, n).over(w) - F.col(column)).withColumn(
            "target", F.coalesce((F.col("price_change") > 0).cast("int"), F.lit(0))
        )

    out = over_blocks(df, body, back=0, ahead=n, **kw)
    return out if keep_last else out.where(F.col("price_change").isNotNull())


FEATURES = (
    "daily_return",
    "high_low_ratio",
    "close_to_open",
    "volume_price_ratio",
    "volume_volatility",
    "sentiment_score_raw",
    "sentiment_ma2",
)


def ohlc_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "high_low_ratio": F.try_divide(F.col("high") - F.col("low"), F.col("open")),
            "close_to_open": F.try_divide(F.col("close") - F.col("open"), F.col("open")),
            "volume_price_ratio": F.col("volume") * F.col("close"),
        }
    )


def create_features(df: DataFrame, score: str = "sentiment_score", label: bool = False, **kw) -> DataFrame:
    """Seven model features; with ``label`` also ``price_change`` / ``target`` (last row kept as 0).

    One pass: all windows share one specification.
    """

    def growth(column: str, w: WindowSpec) -> Column:
        value = F.col(f"_fill_{column}")
        return F.try_divide(value, F.lag(value).over(w)) - 1

    def body(x: DataFrame, w: WindowSpec) -> DataFrame:
        x = x.withColumns(
            {
                "daily_return": growth("close", w),
                "volume_volatility": growth("volume", w),
                "sentiment_score_raw": F.col(score),
                "sentiment_ma2": rolling_mean_over(F.col(score), 2, w),
            }
        )
        if label:
            x = x.withColumn("price_change", F.col("close") - F.lag("close").over(w)).withColumn(
                "target",
                F.coalesce((F.lead("close").over(w) - F.col("close") > 0).cast("int"), F.lit(0)),
            )
        return x

    out = over_blocks(df, body, back=1, ahead=1 if label else 0, fill=["close", "volume"], **kw)
    return ohlc_ratios(out)


def date_spine(df: DataFrame, start: Column | str, end: Column | str, name: str = "date") -> DataFrame:
    """One row per day from ``start`` to ``end`` (columns of ``df``), both included."""
    return df.withColumn(name, F.explode(F.sequence(F.to_date(start), F.to_date(end))))


@null_safe
def trading_day_gaps(df: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """Mondays to Fridays between a ticker's first and last bar that have no bar."""
    keys = as_keys(keys)
    extent = df.groupBy(*keys).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    days = date_spine(extent, F.col("_from"), F.col("_to")).where(F.weekday("date") < 5)
    have = df.select(*keys, "date")
    return days.drop("_from", "_to").join(have, [*keys, "date"], "left_anti")


@null_safe
def gap_summary(df: DataFrame, first: int = 5, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """Number of missing trading days per ticker and the first few of them as text."""
    keys = as_keys(keys)
    gaps = trading_day_gaps(df, keys)
    counts = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_days"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    # row_number <= k is pushed below the shuffle as a per-task group limit.
    early = gaps.withColumn("_r", rank).where(F.col("_r") <= first)
    listed = early.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.col("date").cast("string"))), ",").alias("first_missing")
    )
    return counts.join(listed, keys)


def news_window_bounds(
    news: DataFrame, keys: str | Sequence[str] = "ticker", back: int = 90, ahead: int = 5
) -> DataFrame:
    """Price range worth reading per ticker: 90 days before the first headline to 5 after the last."""
    return news.groupBy(*as_keys(keys)).agg(
        F.date_sub(F.min("date"), back).alias("range_start"),
        F.date_add(F.max("date"), ahead).alias("range_end"),
    )


@null_safe
def bars_in_news_window(
    bars: DataFrame, news: DataFrame, keys: str | Sequence[str] = "ticker"
) -> DataFrame:
    """Bars inside their ticker's news range; the range table has one row per ticker."""
    keys = as_keys(keys)
    bounds = news_window_bounds(news, keys)
    return (
        bars.join(bounds, keys)
        .where(F.col("date").between(F.col("range_start"), F.col("range_end")))
        .drop("range_start", "range_end")
    )


@null_safe
def cumulative_return(
    df: DataFrame,
    rate: str,
    capital: float = 10000.0,
    name: str = "equity",
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
) -> DataFrame:
    """``<name>_cumulative`` with its peak and drawdown."""
    return compounded(row_index(df, keys, order), {name: rate}, capital, keys).drop(INDEX, COUNT)


def drawdown(
    df: DataFrame, column: str, keys: str | Sequence[str] = "ticker", order: str | Sequence[str] = "date"
) -> DataFrame:
    """``peak`` (largest value so far) and ``drawdown`` of a value column."""
    out = running_max(df, column, "peak", keys, order)
    return out.withColumn("drawdown", F.try_divide(F.col(column) - F.col("peak"), F.col("peak")))


def tick_order(ts: str) -> Column:
    """Time, then ``event_id``, as one number: aggregates keep it in their hash table, where a struct
    would make them sort all ticks."""
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(19,0)")
    event = F.col("event_id").cast("decimal(20,0)") + F.lit(Decimal(2**63))
    return micros * F.lit(Decimal(2**64)) + event


def bars_from_ticks(
    ticks: DataFrame, interval: str = "1 day", keys: str | Sequence[str] = "ticker"
) -> DataFrame:
    """Open / high / low / close / volume per interval; ties in time go by ``event_id``."""
    at = tick_order("ts")
    return (
        ticks.groupBy(*as_keys(keys), F.window("ts", interval).alias("_w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .withColumn("bar_start", F.col("_w.start"))
        .drop("_w")
    )
