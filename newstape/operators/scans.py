"""Running aggregates over whole series: products, peaks and exponential averages.

Every scan is local inside a block; only one summary row per block travels further.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
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
    join_summary,
    null_safe,
    row_index,
)

# Rows per sub-block of the exponential scan: decay**-256 stays a finite double for spans >= 2.
SUB_ROWS = 256
# Natural-log distance after which a weight is zero in double arithmetic.
UNDERFLOW = 745.0


def compounded(
    df: DataFrame,
    rates: dict[str, str],
    capital: float,
    keys: str | Sequence[str] = "ticker",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """For each ``name -> rate column``: ``<name>_cumulative``, ``_peak`` and ``_drawdown``.

    ``df`` must carry ``row_idx``. A NULL rate leaves its own row NULL and is skipped by later rows.
    """
    keys = as_keys(keys)
    df = blocks(df, size=size)
    running = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select(
        "*", *[F.product(1 + F.col(c)).over(running).alias(f"_p_{n}") for n, c in rates.items()]
    )
    # A block is summed up by its whole product and the extremes of its running product: the peak
    # of carry * running is carry * max for a carry >= 0 and carry * min below 0.
    seen = {n: F.when(F.col(c).isNotNull(), F.col(f"_p_{n}")) for n, c in rates.items()}
    totals = local.groupBy(*keys, BLOCK).agg(
        *[
            agg
            for n, c in rates.items()
            for agg in (
                F.max_by(f"_p_{n}", INDEX).alias(f"_total_{n}"),
                F.max(seen[n]).alias(f"_high_{n}"),
                F.min(seen[n]).alias(f"_low_{n}"),
            )
        ]
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "*",
        *[
            F.coalesce(F.product(f"_total_{n}").over(before), F.lit(1.0)).alias(f"_carry_{n}")
            for n in rates
        ],
    )
    peaks = carried.select(
        *keys,
        BLOCK,
        *[f"_carry_{n}" for n in rates],
        *[
            F.max(
                F.greatest(
                    F.col(f"_carry_{n}") * F.col(f"_high_{n}"),
                    F.col(f"_carry_{n}") * F.col(f"_low_{n}"),
                )
            )
            .over(before)
            .alias(f"_top_{n}")
            for n in rates
        ],
    )
    out = join_summary(local, peaks, keys, BLOCK)
    # Capital is applied once, to the growth factor, as cumprod() * capital does.
    out = out.withColumns(
        {
            f"{n}_cumulative": F.when(
                F.col(c).isNotNull(), F.col(f"_carry_{n}") * F.col(f"_p_{n}") * F.lit(float(capital))
            )
            for n, c in rates.items()
        }
    )
    out = out.withColumns(
        {
            f"{n}_peak": F.when(
                F.col(c).isNotNull(),
                F.greatest(
                    F.max(f"{n}_cumulative").over(running),
                    F.col(f"_top_{n}") * F.lit(float(capital)),
                ),
            )
            for n, c in rates.items()
        }
    )
    out = out.withColumns(
        {
            f"{n}_drawdown": F.try_divide(
                F.col(f"{n}_cumulative") - F.col(f"{n}_peak"), F.col(f"{n}_peak")
            )
            for n in rates
        }
    )
    helpers = [f"_{part}_{n}" for n in rates for part in ("p", "carry", "top")]
    return out.drop(BLOCK, OWN, *helpers)


@null_safe
def running_max(
    df: DataFrame,
    column: str,
    name: str,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Largest value so far; NULL where the value itself is NULL."""
    keys = as_keys(keys)
    df = blocks(row_index(df, keys, order), size=size)
    running = block_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        df.groupBy(*keys, BLOCK)
        .agg(F.max(column).alias("_top"))
        .select(*keys, BLOCK, F.max("_top").over(before).alias("_before"))
    )
    local = df.withColumn("_local", F.max(column).over(running))
    out = join_summary(local, tops, keys, BLOCK)
    peak = F.when(F.col(column).isNotNull(), F.greatest("_local", "_before"))
    return out.withColumn(name, peak).drop(BLOCK, OWN, INDEX, COUNT, "_local", "_before")


def decay_of(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


@null_safe
def ema(
    df: DataFrame,
    outputs: dict[str, tuple[str, float]],
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    bucket: Column | None = None,
    size: int = BLOCK_ROWS,
    sub: int = SUB_ROWS,
) -> DataFrame:
    """Exponential averages ``name -> (column, span)``: y0 = x0, y = a*x + (1-a)*y, a = 2/(span+1).

    Rows whose source is NULL stay in the result with a NULL average and are stepped over.
    """
    keys = as_keys(keys)
    sources = sorted({column for column, _ in outputs.values()})
    gap = F.greatest(*[F.col(c).isNull() for c in sources], F.lit(False))
    marked = df.withColumn("_gap", gap)
    series = [*keys, "_gap"]
    indexed = blocks(row_index(marked, series, order, bucket), size=size)
    out = decayed_sums(
        indexed,
        {
            name: (
                F.when(F.col(INDEX) == 0, F.col(column)).otherwise(
                    F.col(column) * F.lit(1.0 - decay_of(span))
                ),
                decay_of(span),
            )
            for name, (column, span) in outputs.items()
        },
        series,
        size,
        sub,
    )
    return out.drop("_gap", BLOCK, OWN, INDEX, COUNT)


def decayed_sums(
    df: DataFrame,
    sums: dict[str, tuple[Column, float]],
    keys: Sequence[str],
    size: int = BLOCK_ROWS,
    sub: int = SUB_ROWS,
) -> DataFrame:
    """``s[i] = x[i] + decay * s[i-1]`` for each ``name -> (x, decay)`` over indexed blocks.

    1. Inside a sub-block of ``sub`` rows: sum(x * decay**-k) * decay**k, a plain running sum.
    2. The last value of every full sub-block forms a series ``sub`` times shorter. Its own
       recurrence looks back only until decay**(sub*m) underflows, so it runs on blocks as well.
    3. One small array per row block brings the carries back, on the rows' partitioning.
    """
    if size % sub:
        raise ValueError("size must be a multiple of sub")
    keys = list(keys)
    offset = F.col(INDEX) % F.lit(sub)
    part = F.floor(F.col(INDEX) / F.lit(sub))
    df = df.withColumns({"_sub": part, "_k": offset})
    inside = Window.partitionBy(*keys, BLOCK, "_sub").orderBy(INDEX)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def power(base: float, exponent: Column) -> Column:
        return F.pow(F.lit(base), exponent)

    live = {name: (x, decay) for name, (x, decay) in sums.items() if decay > 0.0}
    local = df.select(
        "*",
        *[
            (F.sum(x * power(1.0 / decay, F.col("_k"))).over(inside) * power(decay, F.col("_k"))).alias(
                f"_local_{name}"
            )
            for name, (x, decay) in live.items()
        ],
        *[x.alias(f"_local_{name}") for name, (x, decay) in sums.items() if decay == 0.0],
    )
    if live:
        ends = local.where(F.col("_k") == sub - 1).select(
            *keys, F.col("_sub").alias("_at"), *[f"_local_{name}" for name in live]
        )
        carries = _carries(ends, {name: decay for name, (_, decay) in live.items()}, keys, sub)
        per_block = (
            carries.withColumn(BLOCK, F.floor(F.col("_next") * F.lit(sub) / F.lit(size)))
            .groupBy(*keys, BLOCK)
            .agg(F.map_from_entries(F.collect_list(F.struct("_next", "_carry"))).alias("_carries"))
        )
        local = join_summary(local, per_block, keys, BLOCK)
    carry = F.col("_carries")[F.col("_sub")] if live else None
    out = local.withColumns(
        {
            name: F.col(f"_local_{name}")
            + power(decay, F.col("_k") + 1) * F.coalesce(carry[name], F.lit(0.0))
            for name, (_, decay) in live.items()
        }
        | {name: F.col(f"_local_{name}") for name in sums if name not in live}
    )
    return out.drop("_sub", "_k", "_carries", *[f"_local_{name}" for name in sums])


def _carries(ends: DataFrame, decays: dict[str, float], keys: list[str], sub: int) -> DataFrame:
    """Value of each recurrence at the end of every full sub-block, keyed by the next sub-block."""
    per_step = {name: decay**sub for name, decay in decays.items()}
    reach = {
        name: math.ceil(UNDERFLOW / (sub * -math.log(decay))) for name, decay in decays.items()
    }
    spread = blocks(ends, back=max(reach.values()), index="_at")
    at = block_window(keys, "_at")

    def fold(name: str) -> Column:
        seen = F.collect_list(f"_local_{name}").over(at.rowsBetween(-reach[name], 0))
        step = F.lit(per_step[name])
        return F.aggregate(seen, F.lit(0.0), lambda acc, end: acc * step + end)

    return (
        spread.select(
            *keys,
            (F.col("_at") + 1).alias("_next"),
            OWN,
            F.struct(*[fold(name).alias(name) for name in decays]).alias("_carry"),
        )
        .where(F.col(OWN))
        .drop(OWN)
    )
