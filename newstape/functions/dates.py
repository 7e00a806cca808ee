"""News dates in the spellings met on pages and in files.

Relative words need a reference date; it is always a parameter, so a re-run gives the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in this order by fix_dates (fixed values).
DATE_FORMATS = (
    "MMM-dd-yyyy",
    "MM/dd/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "yyyyMMdd",
    "yyyy/MM/dd",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ref(ref: Column | dt.date) -> Column:
    return ref if isinstance(ref, Column) else F.lit(ref).cast("date")


def _day(year: Column, month: Column, day: Column) -> Column:
    """Date from a year number, an English month abbreviation and a day; NULL if there is none."""
    text = F.concat_ws("-", year.cast("string"), F.initcap(month), day)
    return F.try_to_timestamp(text, F.lit("yyyy-MMM-dd")).cast("date")


def _month_day_year(text: Column) -> Column:
    """``May-01-23``; two-digit years from 69 on belong to the last century."""
    pattern = r"^([A-Za-z]{3})-(\d{2})-(\d{2})$"
    short = F.try_to_number(F.regexp_extract(text, pattern, 3), F.lit("99")).cast("int")
    century = F.when(short >= 69, 1900).otherwise(2000)
    return F.when(
        text.rlike(pattern),
        _day(century + short, F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)),
    )


def parse_news_date(c: Column | str, ref: Column | dt.date) -> Column:
    """``Today`` / ``Yesterday`` anywhere in the text, ``May-01-23``, ``May-01`` (year of ``ref``)."""
    text, ref = _col(c), _ref(ref)
    short = r"^([A-Za-z]{3})-(\d{2})$"
    return (
        F.when(text.contains("Today"), ref)
        .when(text.contains("Yesterday"), F.date_sub(ref, 1))
        .when(text.rlike(r"^\w{3}-\d{2}-\d{2}"), _month_day_year(text))
        .when(
            text.rlike(short),
            _day(F.year(ref), F.regexp_extract(text, short, 1), F.regexp_extract(text, short, 2)),
        )
    )


def fix_dates(c: Column | str, ref: Column | dt.date) -> Column:
    """Exact ``today`` / ``yesterday`` in any case, any known spelling, else ``ref``."""
    text, ref = F.trim(_col(c).cast("string")), _ref(ref)
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))
    others = [F.try_to_timestamp(F.initcap(text), F.lit(f)).cast("date") for f in DATE_FORMATS]
    return (
        F.when(F.lower(text) == "today", ref)
        .when(F.lower(text) == "yesterday", F.date_sub(ref, 1))
        .otherwise(F.coalesce(iso, _month_day_year(text), *others, ref))
    )


def split_datetime_cell(c: Column | str, dialect: str = "table") -> Column:
    """Struct ``date_text, time_text`` of a page cell such as ``May-31-23 12:45PM``.

    ``table``: two or more parts are date and time, one part is a time.
    ``strict``: only exactly two parts carry a date.
    ``page``: one part is the date, its time is ``N/A``; any white space separates.
    """
    text = F.trim(_col(c))
    parts = F.split(text, r"\s+" if dialect == "page" else " ")
    n, first, second = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    if dialect == "table":
        date_text, time_text = F.when(n >= 2, first), F.when(n >= 2, second).otherwise(first)
    elif dialect == "strict":
        date_text, time_text = F.when(n == 2, first), F.when(n == 2, second).otherwise(first)
    elif dialect == "page":
        date_text = F.when(n >= 2, first).otherwise(text)
        time_text = F.when(n >= 2, second).otherwise(F.lit("N/A"))
    else:
        raise ValueError(f"unknown dialect {dialect!r}")
    return F.struct(date_text.alias("date_text"), time_text.alias("time_text"))


def parse_cell_time(c: Column | str, ref: Column | dt.date) -> Column:
    """Struct ``date, time`` (``HH:mm``) read strictly: ``May-31-23 12:45PM`` or ``12:45PM``.

    Cells that do not parse give NULL in both fields.
    """
    today = F.date_format(_ref(ref), "MMM-dd-yy")
    text = F.replace(F.trim(_col(c)), F.lit("Today"), today)
    dated = text.contains(" ")
    cell = F.split(text, " ", 2)
    day = _month_day_year(F.get(cell, F.lit(0)))
    clock = F.when(dated, F.get(cell, F.lit(1))).otherwise(text)
    time = F.date_format(F.try_to_timestamp(F.upper(clock), F.lit("h:mma")), "HH:mm")
    good = time.isNotNull() & (~dated | day.isNotNull())
    return F.struct(
        F.when(good & dated, day).alias("date"),
        F.when(good, time).alias("time"),
    )


def parse_date_input(c: Column | str) -> Column:
    """ISO text up to a ``T``; NULL when empty or no date."""
    text = F.split_part(_col(c), F.lit("T"), F.lit(1))
    return F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
        F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"),
    )


def in_date_range(c: Column | str, start: Column | dt.date | None, end: Column | dt.date | None) -> Column:
    """Both ends included; a NULL date never matches. A plain predicate, so it reaches the scan."""
    date, keep = _col(c), F.lit(True)
    if start is not None:
        keep = keep & (date >= _ref(start))
    if end is not None:
        keep = keep & (date <= _ref(end))
    return keep & date.isNotNull()
