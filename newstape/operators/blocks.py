"""Ordered series work that never puts one key into one task.

A window partitioned by ticker sends a ticker with a third of all rows to one task. Here every
series is cut twice:

* by **calendar bucket** (a year of dates, an hour of timestamps; an hour with very many rows is cut into ranges of
  time): per-bucket row counts and last values come from a partially aggregated ``groupBy``; prefix sums over that
  small table give each row its global position in its series and the value carried in from earlier buckets;
* by **block of positions** (``BLOCK_ROWS`` rows): a frame of n rows sees at most n-1 rows of the
  preceding blocks, so those rows are copied into the block that needs them and dropped afterwards.

Both cuts depend on the data alone, so a re-run task yields the same rows. A series holds one row
per order value (or the order columns must break ties). Rows whose text key is NULL are a series of
their own; a NULL in a key of another type raises an error.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 4096
#: An hour is crowded from this many rows on (and from a ``CROWDED_SLOTS``-th of all rows, so that there are fewer of them).
CROWDED_ROWS = 65536
CROWDED_SLOTS = 4096
#: Ranges that a crowded hour is cut into, and the rows by which their bounds are chosen.
PIECES = 256
SAMPLED_ROWS = 4096

BUCKET, BLOCK, OWN = "_bucket", "_blk", "_own"
INDEX, COUNT = "row_idx", "row_cnt"


def as_keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


#: Stands for a NULL text key while a series is worked on, as equality joins would lose its rows.
NULL_KEY = "\0"


def fill_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that equality joins can match: NULL text becomes ``NULL_KEY``, any other NULL is an error."""
    filled = {}
    for key in as_keys(keys):
        if not df.schema[key].nullable:
            continue
        if isinstance(df.schema[key].dataType, T.StringType):
            filled[key] = F.coalesce(key, F.lit(NULL_KEY))
        else:
            filled[key] = F.coalesce(key, F.raise_error(F.lit(f"series key {key} is NULL")).cast(df.schema[key].dataType))
    return df.withColumns(filled) if filled else df


def restore_keys(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    texts = [k for k in as_keys(keys) if k in df.columns and isinstance(df.schema[k].dataType, T.StringType)]
    return df.withColumns({k: F.nullif(F.col(k), F.lit(NULL_KEY)) for k in texts}) if texts else df


#: Key of the one series that a table without keys is.
WHOLE = "_whole"


def null_safe(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Wraps an operator over series (``keys``) so that NULL keys keep their rows in every table it is given.

    Tables that lack a key are left as they are in that key. Without any keys all rows are one series. Keys that came
    filled (by an operator around this one) stay so, and with ``keep_index`` all do, as another scan goes on from the
    same partitioning.
    """
    shape = inspect.signature(operator)

    @wraps(operator)
    def run(*args, **kw) -> DataFrame:
        bound = shape.bind(*args, **kw)
        bound.apply_defaults()
        given = as_keys(bound.arguments["keys"])
        whole = not given
        if whole:
            bound.arguments["keys"] = [WHOLE]
        open_keys = set()
        for name, value in bound.arguments.items():
            if isinstance(value, DataFrame):
                rows = value.withColumn(WHOLE, F.lit(0)) if whole else value
                own = [k for k in given if k in value.columns and value.schema[k].nullable]
                open_keys |= set(own)
                bound.arguments[name] = fill_keys(rows, own)
        out = operator(*bound.args, **bound.kwargs)
        if whole:
            return out.drop(WHOLE)
        return out if bound.arguments.get("keep_index") else restore_keys(out, sorted(open_keys))

    return run


def calendar_bucket(df: DataFrame, order: str) -> Column:
    """Coarse calendar slot of the order column: the year of a date, the hour of a timestamp.

    Bars hold at most one row per ticker and interval, so the calendar bounds both the rows of a
    bucket and the buckets of a series. Numbers are cut every ``BLOCK_ROWS``. Rows without a value
    share one bucket and come first.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        slot = F.year(order)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        slot = F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(3600))
    else:
        return position_bucket(order)
    return F.coalesce(slot.cast("bigint"), F.lit(-(2**62)))


def _crowded_pieces(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``BUCKET`` for timestamps: the hour, and inside a crowded hour the range of time the row lies in.

    The bounds of the ranges are instants of rows chosen by a hash of the whole row and then sorted, so every reading of
    the data finds the same ones (sampled bounds of an exchange, or approximate quantiles, would differ between the
    branch that counts and the branch that numbers). Fewer than ``CROWDED_SLOTS`` hours can be crowded, whatever the
    data: that is what bounds the broadcast tables. Rows of one instant stay together.
    """
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    timed = df.withColumn(BUCKET, calendar_bucket(df, order))
    sizes = timed.where(F.col(order).isNotNull()).groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    least = sizes.agg(F.greatest(F.lit(float(CROWDED_ROWS)), F.sum("_n") / F.lit(float(CROWDED_SLOTS))).alias("_least"))
    crowded = sizes.join(F.broadcast(least), F.col("_n") > F.col("_least"))
    shares = crowded.select(*keys, BUCKET, (F.lit(2.0**30 * SAMPLED_ROWS) / F.col("_n")).alias("_share"))
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    drawn = timed.select(*keys, BUCKET, micros.alias("_us"), F.pmod(F.xxhash64(*hashed), F.lit(2**30)).alias("_lot"))
    chosen = drawn.join(F.broadcast(shares), [*keys, BUCKET]).where(F.col("_lot") < F.col("_share"))
    sampled = chosen.groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_set("_us")).alias("_all"))
    step = F.greatest(F.size("_all") / F.lit(float(PIECES)), F.lit(1.0))
    bounds = F.filter("_all", lambda _, i: F.floor(i / step) != F.floor((i - 1) / step))
    cuts = sampled.select(*keys, BUCKET, bounds.alias("_bucket_cuts"))
    placed = timed.join(F.broadcast(cuts), [*keys, BUCKET], "left")
    piece = F.when(F.col("_bucket_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_bucket_cuts", lambda c: c <= F.col("_bucket_us"))))
    slot = F.when(F.col(order).isNull(), F.col(BUCKET)).otherwise(F.col(BUCKET) * F.lit(2 * PIECES) + piece)
    return placed.withColumn("_bucket_us", micros).withColumn(BUCKET, slot).drop("_bucket_cuts", "_bucket_us")


def _undated(df: DataFrame, order: Sequence[str]) -> Column:
    """Bucket of rows without a date: by their number, if the next order column is one; they come first in any case."""
    first = F.lit(-(2**62))
    if len(order) > 1 and isinstance(df.schema[order[1]].dataType, T.IntegralType):
        number = F.floor(F.col(order[1]) / F.lit(BLOCK_ROWS)).cast("bigint")
        return first + F.coalesce(number, F.lit(-(2**52)))
    return first


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``BUCKET`` of every row, from the data alone."""
    kind = df.schema[order[0]].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = _crowded_pieces(df, keys, order[0])
    else:
        out = df.withColumn(BUCKET, calendar_bucket(df, order[0]))
    return out.withColumn(BUCKET, F.when(F.col(order[0]).isNull(), _undated(df, order)).otherwise(F.col(BUCKET)))


def position_bucket(order: str, size: int = BLOCK_ROWS) -> Column:
    """Bucket for series ordered by a number instead of a date."""
    return F.coalesce(F.floor(F.col(order) / F.lit(size)).cast("bigint"), F.lit(-(2**62)))


def row_index(
    df: DataFrame,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    bucket: Column | None = None,
    fill: Sequence[str] = (),
    first: Sequence[str] = (),
) -> DataFrame:
    """Add ``row_idx`` (0-based position in the series) and ``row_cnt`` (series length).

    ``fill`` columns get ``_fill_<c>``: the last non-null value up to the row. ``first`` columns
    get ``_first_<c>``: the value of the first row. Both ride on the same shuffle.
    """
    keys, order = as_keys(keys), as_keys(order)
    stamped = bucketed(df, keys, order) if bucket is None else df.withColumn(BUCKET, bucket)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])

    # max_by / min_by keep plain values in the buffer where the order is one column, so the partial
    # aggregation hashes; it sorts only for composite orders.
    per_bucket = stamped.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_last_{c}") for c in fill],
        *[F.min_by(c, position).alias(f"_head_{c}") for c in first],
    )
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = per_bucket.select(
        *keys,
        BUCKET,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias(COUNT),
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in fill],
        *[F.first(f"_head_{c}").over(whole).alias(f"_first_{c}") for c in first],
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = stamped.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *[F.last(c, ignorenulls=True).over(so_far).alias(f"_seen_{c}") for c in fill],
    )
    joined = join_summary(numbered, offsets, keys, BUCKET)
    out = joined.withColumn(INDEX, F.col("_offset") + F.col("_rn") - 1)
    for c in fill:
        out = out.withColumn(f"_fill_{c}", F.coalesce(f"_seen_{c}", f"_carry_{c}"))
    helpers = [f"_{part}_{c}" for c in fill for part in ("seen", "carry")]
    return out.drop(BUCKET, "_offset", "_rn", *helpers)


def join_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str], part: str) -> DataFrame:
    """Join per-part values back to the rows. Plain equality on (keys, part): it matches the
    partitioning the window already needs, so the rows are not shuffled a second time."""
    return rows.join(summary, [*keys, part], "left")


def blocks(
    df: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK_ROWS, index: str = INDEX
) -> DataFrame:
    """Assign rows to position blocks, copying each row to every block whose frames reach it.

    ``back`` / ``ahead``: how many rows before / after a row its frames may read. A frame that
    already sits on blocks (``over_blocks(keep_index=True)``) is left as it is.
    """
    if BLOCK in df.columns:
        return df
    i = F.col(index)
    if back == 0 and ahead == 0:
        return df.withColumn(BLOCK, F.floor(i / F.lit(size))).withColumn(OWN, F.lit(True))
    lowest = F.greatest(F.floor((i - F.lit(ahead)) / F.lit(size)), F.lit(0))
    highest = F.floor((i + F.lit(back)) / F.lit(size))
    copied = df.withColumn(BLOCK, F.explode(F.sequence(lowest, highest)))
    return copied.withColumn(OWN, F.col(BLOCK) == F.floor(i / F.lit(size)))


def block_window(keys: Sequence[str], index: str = INDEX) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(index)


@null_safe
def over_blocks(
    df: DataFrame,
    body: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int,
    ahead: int = 0,
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    bucket: Column | None = None,
    fill: Sequence[str] = (),
    size: int = BLOCK_ROWS,
    keep_index: bool = False,
) -> DataFrame:
    """Run ``body(frame, window)`` on blocks and give back each input row once.

    ``keep_index`` leaves position and block on the rows, so that a scan can go on from the same
    partitioning.
    """
    keys = as_keys(keys)
    indexed = row_index(df, keys, order, bucket, fill)
    out = body(blocks(indexed, back, ahead, size), block_window(keys)).where(F.col(OWN))
    out = out.drop(*[f"_fill_{c}" for c in fill])
    return out if keep_index else out.drop(BLOCK, OWN, INDEX, COUNT)


@null_safe
def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    keys: str | Sequence[str] = "ticker",
    order: str | Sequence[str] = "date",
    bucket: Column | None = None,
) -> DataFrame:
    """Replace NULL by the last value seen earlier in the series."""
    filled = row_index(df, keys, order, bucket, fill=columns)
    return filled.withColumns({c: F.col(f"_fill_{c}") for c in columns}).drop(
        INDEX, COUNT, *[f"_fill_{c}" for c in columns]
    )
