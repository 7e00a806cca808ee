"""Long-or-flat strategies on daily closes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from newstape.operators.blocks import COUNT, INDEX, as_keys, null_safe, over_blocks
from newstape.operators.joins import join_sentiment
from newstape.operators.scans import compounded

CAPITAL = 10000.0
TRADING_DAYS = 252
RISK_FREE = 0.02

SERIES = (
    "asset_returns",
    "strategy_returns",
    "asset_cumulative",
    "strategy_cumulative",
    "asset_peak",
    "strategy_peak",
    "asset_drawdown",
    "strategy_drawdown",
)


def _position(score: str, threshold: float) -> Column:
    return (F.coalesce(F.col(score), F.lit(0.0)) > threshold).cast("int")


def _signals(x: DataFrame, w: WindowSpec, score: str, threshold: float) -> DataFrame:
    x = x.withColumns({"position": _position(score, threshold), "next_close": F.lead("close").over(w)})
    return x.withColumns(
        {
            "price_change": F.col("next_close") - F.col("close"),
            "actual": (F.col("next_close") > F.col("close")).cast("int"),
        }
    )


def _rates(x: DataFrame, w: WindowSpec, price: Column, position: str) -> DataFrame:
    asset = F.try_divide(price, F.lag(price).over(w)) - 1
    x = x.withColumn("asset_returns", asset)
    return x.withColumn(
        "strategy_returns", F.coalesce(F.lag(position).over(w) * F.col("asset_returns"), F.lit(0.0))
    )


def sentiment_positions(
    bars: DataFrame,
    daily: DataFrame,
    threshold: float = 0.05,
    keys: str | Sequence[str] = "ticker",
    score: str = "sentiment_score",
) -> DataFrame:
    """1 where the day's score is above the threshold, with the next day's direction as ``actual``.

    Rows without a close are no bars; each ticker's last row has no next day and is dropped.
    """
    joined = join_sentiment(bars.where(F.col("close").isNotNull()), daily, keys)
    marked = over_blocks(
        joined, lambda x, w: _signals(x, w, score, threshold), back=0, ahead=1, keys=keys
    )
    return marked.where(F.col("price_change").isNotNull())


@null_safe
def calculate_returns(
    df: DataFrame,
    price: str = "close",
    position: str = "position",
    capital: float = CAPITAL,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
) -> DataFrame:
    """Returns, equity, peaks and drawdowns of the asset and of the strategy.

    A position earns the return of the following row. Returns and both equity curves come from one
    block pass plus one small join of block totals.
    """
    rated = over_blocks(
        df,
        lambda x, w: _rates(x, w, F.col(f"_fill_{price}"), position),
        back=1,
        keys=keys,
        order=order,
        fill=[price],
        keep_index=True,
    )
    rates = {"asset": "asset_returns", "strategy": "strategy_returns"}
    return compounded(rated, rates, capital, keys).drop(INDEX, COUNT)


def _performance_sums(order: str) -> list[Column]:
    daily_free = (1.0 + RISK_FREE) ** (1.0 / TRADING_DAYS) - 1.0
    excess = F.col("strategy_returns") - F.lit(daily_free)
    return [
        F.max_by("strategy_cumulative", order).alias("final_value"),
        F.min("strategy_drawdown").alias("max_drawdown"),
        F.avg(excess).alias("_mean"),
        F.stddev_samp(excess).alias("_std"),
        F.count_if(F.col("strategy_returns") > 0).alias("_wins"),
        F.count_if(F.col("strategy_returns") < 0).alias("_losses"),
        F.count(F.lit(1)).alias("trading_days"),
    ]


def _performance_columns(capital: float) -> list[Column]:
    growth = F.col("final_value") / F.lit(capital)
    years_inverse = F.lit(float(TRADING_DAYS)) / F.col("trading_days")
    sharpe = F.sqrt(F.lit(float(TRADING_DAYS))) * F.try_divide("_mean", "_std")
    return [
        F.lit(float(capital)).alias("initial_capital"),
        F.col("final_value"),
        (growth - 1).alias("total_return"),
        F.when(growth >= 0, F.pow(growth, years_inverse) - 1).alias("annualized_return"),
        F.col("max_drawdown"),
        sharpe.alias("sharpe_ratio"),
        _ratio(F.col("_wins"), F.col("_wins") + F.col("_losses")).alias("win_rate"),
        F.col("trading_days"),
    ]


def _ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def _confusion_sums(predicted: str, actual: str) -> list[Column]:
    p, a = F.col(predicted), F.col(actual)
    return [
        F.count_if((p == 1) & (a == 1)).alias("true_positives"),
        F.count_if((p == 1) & (a == 0)).alias("false_positives"),
        F.count_if((p == 0) & (a == 0)).alias("true_negatives"),
        F.count_if((p == 0) & (a == 1)).alias("false_negatives"),
    ]


def _confusion_columns() -> list[Column]:
    cells = ("true_positives", "false_positives", "true_negatives", "false_negatives")
    tp, fp, tn, fn = (F.col(c) for c in cells)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [
        *[F.col(c) for c in cells],
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2.0 * precision * recall, precision + recall).alias("f1_score"),
    ]


def performance_metrics(
    returns: DataFrame,
    capital: float = CAPITAL,
    keys: str | Sequence[str] = "ticker",
    order: str = "date",
) -> DataFrame:
    """One row per ticker: final value, total and annualized return, drawdown, Sharpe, win rate."""
    keys = as_keys(keys)
    return returns.groupBy(*keys).agg(*_performance_sums(order)).select(*keys, *_performance_columns(capital))


def signal_confusion(
    df: DataFrame,
    predicted: str = "position",
    actual: str = "actual",
    keys: str | Sequence[str] = "ticker",
) -> DataFrame:
    """Confusion counts of 0/1 columns, accuracy, precision, recall and F1 of class 1 (0 when
    undefined)."""
    keys = as_keys(keys)
    return df.groupBy(*keys).agg(*_confusion_sums(predicted, actual)).select(*keys, *_confusion_columns())


@null_safe
def sentiment_returns(
    bars: DataFrame,
    daily: DataFrame,
    threshold: float = 0.05,
    capital: float = CAPITAL,
    keys: str | Sequence[str] = "ticker",
    score: str = "sentiment_score",
) -> DataFrame:
    """Positions and their return series in one block pass.

    Only the last row of a series lacks a next day, so dropping it changes no other row's
    neighbours and the positions need no pass of their own.
    """

    def body(x: DataFrame, w: WindowSpec) -> DataFrame:
        return _rates(_signals(x, w, score, threshold), w, F.col("close"), "position")

    joined = join_sentiment(bars.where(F.col("close").isNotNull()), daily, keys)
    rated = over_blocks(joined, body, back=1, ahead=1, keys=keys, keep_index=True)
    rates = {"asset": "asset_returns", "strategy": "strategy_returns"}
    kept = rated.where(F.col("price_change").isNotNull())
    return compounded(kept, rates, capital, keys).drop(INDEX, COUNT)


def report(
    returns: DataFrame, predicted: str, actual: str, capital: float = CAPITAL, keys: str | Sequence[str] = "ticker"
) -> DataFrame:
    """Performance and signal quality side by side, one row per ticker, from one aggregation."""
    keys = as_keys(keys)
    sums = returns.groupBy(*keys).agg(*_performance_sums("date"), *_confusion_sums(predicted, actual))
    return sums.select(*keys, *_performance_columns(capital), *_confusion_columns())


def backtest_sentiment_strategy(
    bars: DataFrame,
    daily: DataFrame,
    threshold: float = 0.05,
    capital: float = CAPITAL,
    keys: str | Sequence[str] = "ticker",
) -> tuple[DataFrame, DataFrame]:
    """(daily return series, one metrics row per ticker)."""
    returns = sentiment_returns(bars, daily, threshold, capital, keys)
    return returns, report(returns, "position", "actual", capital, keys)


def backtest_model(
    predictions: DataFrame,
    price: str = "close",
    capital: float = CAPITAL,
    keys: str | Sequence[str] = "ticker",
) -> tuple[DataFrame, DataFrame]:
    """Backtest rows that carry ``prediction``, ``probability`` and ``target`` next to the price."""
    placed = predictions.withColumn("position", F.col("prediction").cast("int")).withColumnRenamed(
        "target", "actual"
    )
    returns = calculate_returns(placed, price, "position", capital, keys)
    return returns, report(returns, "position", "actual", capital, keys)
