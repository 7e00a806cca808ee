"""Reading and writing the tables of the data model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstape.functions.dates import in_date_range
from newstape.operators.blocks import fill_keys, restore_keys
from newstape.schema import BARS, NEWS


def _read(spark: SparkSession, path: str | Sequence[str], schema: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def read_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    tickers: Sequence[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    fmt: str = "parquet",
    schema: str = BARS,
) -> DataFrame:
    """Price bars of the chosen tickers and dates; both predicates reach the scan."""
    return select_bars(_read(spark, path, schema, fmt), tickers, start, end)


def select_bars(
    bars: DataFrame,
    tickers: Sequence[str] | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(list(tickers)))
    if start is not None or end is not None:
        bars = bars.where(in_date_range("date", start, end))
    return bars


def ticker_of_file() -> Column:
    """Ticker from a file name such as ``ABC_stock_data.csv``: the part before the first ``_``."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # names come percent-encoded
    return F.upper(F.split_part(name, F.lit("_"), F.lit(1)))


def read_ticker_files(spark: SparkSession, path: str, schema: str = BARS, fmt: str = "csv") -> DataFrame:
    """Per-ticker files without a ticker column; the ticker comes from the file name."""
    fields = T.StructType([f for f in T._parse_datatype_string(schema).fields if f.name != "ticker"])
    reader = spark.read.schema(fields)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    raw = reader.format(fmt).load(path)
    return raw.select(ticker_of_file().alias("ticker"), "*")


def read_news(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: str = NEWS
) -> DataFrame:
    return _read(spark, path, schema, fmt)


def drop_header_rows(raw: DataFrame, schema: str = BARS, date: str = "date") -> DataFrame:
    """Typed rows of a table read as text, without repeated header lines wherever they stand."""
    fields = T._parse_datatype_string(schema).fields
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields if f.name in raw.columns]
    return raw.select(*typed).where(F.col(date).isNotNull())


def drop_invalid_dates(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn(date, F.col(date).try_cast("date")).where(F.col(date).isNotNull())


def list_datasets(bars: DataFrame, *sentiment: DataFrame) -> DataFrame:
    """Tickers with bars and with sentiment in any of the given tables, upper case, sorted."""

    def tickers(df: DataFrame) -> DataFrame:
        return df.select(F.upper("ticker").alias("ticker")).distinct()

    known = tickers(sentiment[0])
    for other in sentiment[1:]:
        known = known.union(tickers(other))
    return tickers(bars).join(known, "ticker", "left_semi").orderBy("ticker")


def first_available(first: DataFrame, second: DataFrame, key: str = "ticker") -> DataFrame:
    """All rows of ``first``, and those of ``second`` for tickers that ``first`` lacks. NULL is a ticker like any other."""
    known = fill_keys(first.select(key), key).distinct()
    rest = restore_keys(fill_keys(second, key).join(known, key, "left_anti").select(second.columns), key)
    return first.unionByName(rest, allowMissingColumns=True)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("ticker",), fmt: str = "parquet"
) -> None:
    """Replace a table. Partition folders suit a bounded number of tickers; each task writes its own
    files, so a large ticker is not gathered in one."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
