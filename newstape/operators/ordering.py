"""Top rows, duplicates, time-ordered splits and carried dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstape.operators.blocks import COUNT, INDEX, as_keys, null_safe, row_index


def recent(df: DataFrame, n: int = 10, keys: str | Sequence[str] = "ticker", order: str = "date") -> DataFrame:
    """Last n rows per ticker. ``row_number <= n`` becomes a per-task group limit before the
    shuffle, so at most n rows per ticker and task travel."""
    rank = F.row_number().over(Window.partitionBy(*as_keys(keys)).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def sort_recent(df: DataFrame, order: Sequence[str] = ("date",), ties: Sequence[str] = ()) -> DataFrame:
    """Newest first; ``ties`` settle rows of the same time."""
    return df.orderBy(*[F.desc(c) for c in order], *[F.asc(c) for c in ties])


def dedup_headlines(
    df: DataFrame,
    first_by: Sequence[str],
    keys: Sequence[str] = ("ticker", "headline"),
) -> DataFrame:
    """First row per headline in ``first_by`` order.

    An aggregate, not a ranking window: copies are merged per task before the shuffle, so a headline
    with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(first_by)])
    row = F.struct(order.alias("_order"), *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def combine_sources(
    frames: Sequence[DataFrame | None], ties: str = "row_idx", dedup: bool = True
) -> DataFrame:
    """Union of headline tables in priority order, first copy of each headline, newest first.

    Missing sources are skipped; ``ties`` is the row order inside a source.
    """
    present = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames) if f is not None]
    if not present:
        raise ValueError("no source given")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
    if dedup:
        union = dedup_headlines(union, ["source_rank", ties])
    return sort_recent(union, ["date"], ["source_rank", ties])


@null_safe
def time_split(
    df: DataFrame, test_size: float = 0.2, keys: str | Sequence[str] = "ticker", order: str | Sequence[str] = "date"
) -> DataFrame:
    """``role`` = train for the first int(n * (1 - test_size)) rows of each series, else test."""
    cut = F.floor(F.col(COUNT) * F.lit(1.0 - test_size))
    split = row_index(df, keys, order)
    return split.withColumn("role", F.when(F.col(INDEX) < cut, "train").otherwise("test")).drop(INDEX, COUNT)


def fold_count(n: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 10)))


@null_safe
def time_series_folds(
    df: DataFrame,
    k: int | None = None,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
) -> DataFrame:
    """Expanding windows in long form: each row once per fold it takes part in (``fold``, ``role``).

    k defaults to min(5, max(2, n // 10)); test folds of n // (k + 1) rows lie at the tail, the
    training part is everything before the test fold.
    """
    indexed = row_index(df, keys, order)
    folds = F.lit(k).cast("bigint") if k is not None else fold_count(F.col(COUNT)).cast("bigint")
    sized = indexed.withColumns({"_k": folds, "_size": F.floor(F.col(COUNT) / (folds + 1))})

    def start(fold: Column) -> Column:
        return F.col(COUNT) - (F.col("_k") - fold) * F.col("_size")

    takes_part = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1),
        lambda f: F.col(INDEX) < start(f) + F.col("_size"),
    )
    long = sized.withColumn("fold", F.explode(takes_part))
    role = F.when(F.col(INDEX) < start(F.col("fold")), "train").otherwise("test")
    return long.withColumn("role", role).drop("_k", "_size", INDEX, COUNT)


def carry_forward_date(
    df: DataFrame, date: str = "date", page: str = "page_id", order: str = "row_idx", drop_undated: bool = True
) -> DataFrame:
    """Rows without a date take the last one above them on the page.

    The window is one page, which was a single row of the page table, so its size is bounded by it.
    """
    above = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(date, F.last(date, ignorenulls=True).over(above))
    return out.where(F.col(date).isNotNull()) if drop_undated else out


def best_model(results: DataFrame, score: str = "f1", order: str = "train_order") -> DataFrame:
    """Row with the highest score; the one trained first wins a tie."""
    return results.orderBy(F.desc(score), F.asc(order)).limit(1)


def sort_importance(coefficients: DataFrame) -> DataFrame:
    """Mean coefficient per feature, largest first."""
    return (
        coefficients.groupBy("feature")
        .agg(F.avg("coefficient").alias("average_coefficient"))
        .orderBy(F.desc("average_coefficient"), F.asc("feature"))
    )
