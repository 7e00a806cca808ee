"""Headlines from stored web pages.

HTML has no Catalyst expression, so one function in Python turns each page into raw cells;
dates, carries and limits are DataFrame work afterwards.
"""

from __future__ import annotations

import datetime as dt
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstape.functions.dates import parse_news_date, split_datetime_cell
from newstape.operators.ordering import carry_forward_date
from newstape.sources.selectors import VOID, select_items

# How the two page layouts mark their parts.
TABLE_ID = "news-table"
TABLE_CLASS = "fullview-news-outer"
CARD_SECTION = "collection__elements"
CARD = "element--article"
CARD_HEADLINE = "article__headline"

ROW_SHAPE = "page_id bigint, row_idx int, date_cell string, headline string, second_cell string, has_link boolean"
CARD_SHAPE = "page_id bigint, row_idx int, headline string"


class _TableRows(HTMLParser):
    """Rows of the news table: text of the first two cells and of the first link."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.depth = 0  # nested tables inside the news table
        self.row: dict | None = None
        self.cell = -1
        self.in_cell = self.in_link = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            if self.depth:
                self.depth += 1
            else:
                given = dict(attrs)
                classes = (given.get("class") or "").split()
                if given.get("id") == TABLE_ID or TABLE_CLASS in classes:
                    self.depth = 1
        if not self.depth:
            return
        if tag == "tr":
            self.row = {"cells": [], "link": None}
            self.rows.append(self.row)
            self.in_cell = self.in_link = False
        elif self.row is not None and tag == "td":
            self.row["cells"].append("")
            self.in_cell = True
        elif self.row is not None and tag == "a" and self.row["link"] is None:
            self.row["link"] = ""
            self.in_link = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag == "td":
            self.in_cell = False
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data: str) -> None:
        if not self.depth or self.row is None:
            return
        if self.in_cell:
            self.row["cells"][-1] += data
        if self.in_link:
            self.row["link"] += data


class _Headings(HTMLParser):
    """Texts of headings, optionally only article cards: a linked heading inside a card."""

    def __init__(self, heading: str, cards: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.cards = heading, cards
        self.open: list[tuple[str, frozenset]] = []
        self.found: list[tuple[int, str]] = []  # (number of the heading or card, text)
        self.text: str | None = None
        self.place = -1
        self.done = False  # headline of the current card is taken

    def _inside(self, css: str) -> bool:
        return any(css in classes for _, classes in self.open)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = frozenset((dict(attrs).get("class") or "").split())
        if tag not in VOID:
            self.open.append((tag, classes))
        if not self.cards:
            if tag == self.heading:
                self.text = ""
                self.place += 1
        elif tag == "div" and CARD in classes and self._inside(CARD_SECTION):
            self.done = False
            self.place += 1
        elif tag == "a" and not self.done and self.text is None:
            if self._inside(CARD_SECTION) and self._inside(CARD) and self._inside(CARD_HEADLINE):
                self.text = ""

    def handle_endtag(self, tag: str) -> None:
        if self.text is not None and tag == ("a" if self.cards else self.heading):
            self.found.append((self.place, self.text.strip()))
            self.text, self.done = None, True
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text += data


class RowLayout(NamedTuple):
    """Selectors of another page layout: the rows, and inside a row its date, its link and a second cell."""

    row: str
    date: str = "td"
    link: str = "a"
    second: str = "td[2]"


class CardLayout(NamedTuple):
    """Selectors of another page layout: the cards and the headline inside a card."""

    card: str
    headline: str


def _table_rows(page_id: int, html: str) -> list[tuple]:
    parser = _TableRows()
    parser.feed(html)
    parser.close()
    out = []
    for i, row in enumerate(parser.rows):
        cells = [c.strip() for c in row["cells"]]
        link = row["link"]
        out.append(
            (
                page_id,
                i,
                cells[0] if cells else None,
                link.strip() if link is not None else None,
                cells[1] if len(cells) > 1 else None,
                link is not None,
            )
        )
    return out


def _per_page(pages: DataFrame, parse, shape: str) -> DataFrame:
    """Rows that ``parse`` finds on each page. A plain function over one page: pages go to Python by the hundred, where
    an Arrow batch holds ten thousand of them, whatever their length, and their rows as well."""
    shown = T.StructType.fromDDL(shape)

    def run(page_id: int, html: str | None) -> list[tuple]:
        return parse(page_id, html) if html else []

    rows = F.udf(run, T.ArrayType(shown), useArrow=False)
    return pages.select(F.inline(rows(F.col("page_id").cast("bigint"), "html")))


def extract_news_rows(pages: DataFrame, layout: RowLayout | None = None) -> DataFrame:
    """Every table row of each page's news table with its cells and link text, in page order.

    ``layout`` reads the rows of other pages by its selectors.
    """
    if layout is not None:
        fields = {"date_cell": layout.date, "headline": layout.link, "second_cell": layout.second}
        rows = select_items(pages, layout.row, fields)
        return rows.withColumn("has_link", F.col("headline").isNotNull())
    return _per_page(pages, _table_rows, ROW_SHAPE)


def extract_headings(pages: DataFrame, heading: str = "h1") -> DataFrame:
    """Heading texts of each page in page order."""

    def parse(page_id: int, html: str) -> list[tuple]:
        parser = _Headings(heading, cards=False)
        parser.feed(html)
        parser.close()
        return [(page_id, i, text) for i, text in parser.found]

    return _per_page(pages, parse, CARD_SHAPE)


def extract_article_cards(pages: DataFrame, fetched: Column | dt.date, layout: CardLayout | None = None) -> DataFrame:
    """Headlines of article cards; ``row_idx`` counts cards, also those without a headline. Cards
    carry no usable date: the fetch date, time ``00:00``. ``layout`` finds other cards by its selectors."""

    def parse(page_id: int, html: str) -> list[tuple]:
        parser = _Headings("h3", cards=True)
        parser.feed(html)
        parser.close()
        return [(page_id, i, text) for i, text in parser.found]

    day = fetched if isinstance(fetched, Column) else F.lit(fetched)
    if layout is not None:
        cards = select_items(pages, layout.card, {"headline": layout.headline}).where(F.col("headline").isNotNull())
    else:
        cards = _per_page(pages, parse, CARD_SHAPE)
    return cards.select("page_id", "row_idx", day.alias("date"), F.lit("00:00").alias("time"), "headline")


def limit_rows_per_page(rows: DataFrame, n: int) -> DataFrame:
    """Rows among the first n table rows (or cards) of their page; rows without a link count."""
    return rows.where(F.col("row_idx") < n)


def news_from_rows(
    rows: DataFrame, ref: Column | dt.date, dialect: str = "table", drop_undated: bool = True
) -> DataFrame:
    """Dated headlines of extracted rows.

    ``table`` / ``strict``: rows with a link; a time-only row takes the date of the last linked row
    above it. ``page``: rows with two cells; the second one is the headline, dates carry likewise.
    """
    if dialect == "page":
        kept = rows.where(F.col("second_cell").isNotNull()).withColumn("headline", F.col("second_cell"))
        split_as = "table"
    else:
        kept, split_as = rows.where(F.col("has_link")), dialect
    cell = split_datetime_cell(F.coalesce(F.col("date_cell"), F.lit("")), split_as)
    parsed = kept.withColumn("_cell", cell).select(
        "page_id",
        "row_idx",
        parse_news_date(F.col("_cell.date_text"), ref).alias("date"),
        F.col("_cell.time_text").alias("time"),
        "headline",
    )
    return carry_forward_date(parsed, drop_undated=drop_undated)


def news_from_pages(
    pages: DataFrame,
    ref: Column | dt.date,
    max_articles: int | None = None,
    dialect: str = "table",
    drop_undated: bool = True,
    source: str = "table",
    layout: RowLayout | None = None,
) -> DataFrame:
    """Pages to dated headlines; ``max_articles`` limits table rows per page if given."""
    rows = extract_news_rows(pages, layout)
    if max_articles is not None:
        rows = limit_rows_per_page(rows, max_articles)
    return news_from_rows(rows, ref, dialect, drop_undated).withColumn("source", F.lit(source))
