import datetime as dt

import pytest
from pyspark.sql import functions as F

from newstape.sources import pages

REF = dt.date(2024, 3, 15)
TABLE = """
<table><tr><td>other</td></tr></table>
<table id="news-table" class="fullview-news-outer">
<tr><td>09:00AM</td><td><a>orphan</a></td></tr>
<tr><td>May-31-23 12:45PM</td><td><a>first &amp; <b>best</b></a> <a>again</a></td></tr>
<tr><td>11:30AM</td><td><a>second</a></td></tr>
<tr><td>May-30-23 04:00PM</td><td>no link</td></tr>
<tr><td>10:00AM</td><td><a>third</a></td></tr>
</table><a>outside</a>
"""
CARDS = """
<div class="element--article"><h3 class="article__headline"><a>not in the section</a></h3></div>
<div class="collection__elements">
 <div class="element--article x"><h3 class="article__headline"><a href="#">One <i>A</i></a> <a>more</a></h3>
   <span class="article__timestamp">Aug. 5</span><br></div>
 <div class="element--article"><h3><a>no class</a></h3></div>
 <div class="element--article"><h3 class="article__headline">no link</h3></div>
 <div class="element--article"><h3 class="article__headline"><a>Two</a></h3></div>
</div>
"""


@pytest.fixture(scope="module")
def site(spark):
    rows = [(1, "u", TABLE), (2, "u", CARDS), (3, "u", None), (4, "u", "<h1>He<em>ad</em></h1><p>x</p><h1>two</h1>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def found(df):
    return [(r.date, r.time, r.headline) for r in df.orderBy("page_id", "row_idx").collect()]


def test_table_dialect(site):
    d = dt.date(2023, 5, 31)
    assert found(pages.news_from_pages(site, REF)) == [
        (d, "12:45PM", "first & best"), (d, "11:30AM", "second"), (d, "10:00AM", "third"),
    ]
    assert [h for *_, h in found(pages.news_from_pages(site, REF, max_articles=4))] == ["first & best", "second"]
    kept = found(pages.news_from_pages(site, REF, drop_undated=False))
    assert kept[0] == (None, "09:00AM", "orphan")


def test_page_dialect(site):
    out = found(pages.news_from_pages(site, REF, dialect="page"))
    assert out == [
        (dt.date(2023, 5, 31), "12:45PM", "first & best again"),
        (dt.date(2023, 5, 31), "11:30AM", "second"),
        (dt.date(2023, 5, 30), "04:00PM", "no link"),
        (dt.date(2023, 5, 30), "10:00AM", "third"),
    ]


def test_cards_and_headings(site):
    assert found(pages.extract_article_cards(site, REF)) == [(REF, "00:00", "One A"), (REF, "00:00", "Two")]
    cards = pages.extract_article_cards(site, REF)
    assert [r.row_idx for r in cards.orderBy("row_idx").collect()] == [0, 3]
    assert found(pages.limit_rows_per_page(cards, 3)) == [(REF, "00:00", "One A")]
    heads = pages.extract_headings(site.where(F.col("page_id") == 4))
    assert [r.headline for r in heads.orderBy("row_idx").collect()] == ["Head", "two"]


def test_only_needed_columns_reach_python(site):
    plan = pages.extract_news_rows(site)._jdf.queryExecution().optimizedPlan().toString()
    assert "url" not in plan.split("Project")[-1].split("\n")[0]


def test_pages_reach_python_in_small_batches(spark):
    """Three thousand pages of one task: a row-wise batch holds a hundred of them, an Arrow batch held them all."""
    html = "<table id='news-table'>" + "<tr><td>Jan-01-24 12:45PM</td><td><a href='#'>x</a></td></tr>" * 2 + "</table>"
    given = spark.range(3000).coalesce(1).select(F.col("id").alias("page_id"), F.when(F.col("id") != 7, F.lit(html)).alias("html"))
    rows = pages.extract_news_rows(given)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan and "InArrow" not in plan
    assert rows.count() == 2 * 2999 and rows.where("page_id is null or row_idx > 1 or not has_link").count() == 0
