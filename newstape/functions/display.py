"""Values as the report tables print them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close")
# Smaller than half a unit of the fourth decimal: printed as 0, never as -0.0000.
TINY = 5e-5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", F.round(_col(c), 2)))


def clip_tiny(c: Column | str) -> Column:
    value = _col(c)
    return F.when(F.abs(value) < TINY, F.lit(0.0)).otherwise(value)


def score_text(c: Column | str) -> Column:
    value = _col(c)
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.4f", F.round(clip_tiny(value), 4)))


def count_text(c: Column | str) -> Column:
    return F.coalesce(F.format_number(_col(c).cast("bigint"), 0), F.lit("0"))


def date_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def header_title(name: str) -> str:
    return name.replace("_", " ").title()


def display_bars(df: DataFrame) -> DataFrame:
    """Dates, prices and volumes of bars as text."""
    prices = {c: money(c) for c in PRICE_COLUMNS if c in df.columns}
    volume = {"volume": count_text("volume")} if "volume" in df.columns else {}
    return df.withColumns({"date": date_text("date"), **prices, **volume})


def display_sentiment(df: DataFrame, hidden: tuple[str, ...] = ("sentiment_color",)) -> DataFrame:
    """Daily sentiment as text: scores to four decimals, counts with separators."""
    out = df.drop(*hidden)
    changed = {"date": date_text("date")}
    for name, kind in out.dtypes:
        if name.endswith("_count"):
            changed[name] = count_text(name)
        elif kind == "double":
            changed[name] = score_text(name)
    return out.withColumns(changed)


def with_titles(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: header_title(c) for c in df.columns})
