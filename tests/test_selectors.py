import datetime as dt

import pytest

from newstape.sources import pages, selectors

BROKEN = """<div class="list wide"><ul id=menu><li><a href="/1">One &amp; <b>more</b></a><li><a>Two</a><ul><li>in<a href>ner</a></ul></li></ul>
<p>first<p>second</div></span><ul><li>out<script>var x = "<li>no</li>";</script></ul><img class=pic src=i.png>"""
TABLE = """<table id="{}"><tr><td>Jan-02-24 09:30AM<td><a href="#">Up</a> (x)<tr><td>10:00AM</td><td>none</td></tr>
<tr><td><table><tr><td>deep</td></tr></table></td></tr></table>"""


def found(spark, html, item, fields):
    frame = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    return [tuple(r)[1:] for r in selectors.select_items(frame, item, fields).orderBy("row_idx").collect()]


def test_broken_markup(spark):
    fields = {"text": ".", "link": "a", "to": "a@href", "bold": "a b", "other": "a[2]"}
    assert found(spark, BROKEN, "#menu li", fields) == [
        (0, "One & more", "One & more", "/1", "more", None),
        (1, "Twoinner", "Two", None, None, "ner"),
        (2, "inner", "ner", "", None, None),
    ]
    assert found(spark, BROKEN, "p", {"text": "."}) == [(0, "first"), (1, "second")]
    assert found(spark, BROKEN, "div.wide.list li, img.pic", {"text": ".", "src": ".@src"}) == [
        (0, "One & more", None), (1, "Twoinner", None), (2, "inner", None), (3, "", "i.png")
    ]
    assert [r[1] for r in found(spark, BROKEN, "ul li", {"text": "."})][-1] == "out"
    assert found(spark, BROKEN, "div div li", {"text": "."}) == []
    assert len(found(spark, "<b>" * 3000 + "x", "b", {"text": "."})) == 3000


def test_selectors_that_are_none():
    for text in ("", "a,,b", "a > b", "a:hover", "[x]"):
        with pytest.raises(ValueError):
            selectors.steps_of(text)


def test_the_table_layout_by_selectors_equals_its_own_parser(spark):
    frame = spark.createDataFrame([(7, TABLE.format("news-table")), (8, TABLE.format("other"))], "page_id long, html string")
    own = pages.extract_news_rows(frame).orderBy("row_idx").collect()
    same = pages.extract_news_rows(frame, pages.RowLayout("table#news-table tr")).orderBy("row_idx").collect()
    for a, b in zip(own[:2], same[:2], strict=True):
        assert (a.page_id, a.row_idx, a.headline, a.has_link) == (b.page_id, b.row_idx, b.headline, b.has_link)
    assert [r.second_cell for r in same] == ["Up (x)", "none", "deep", None]
    news = pages.news_from_pages(frame, dt.date(2024, 3, 1), layout=pages.RowLayout("#other tr")).collect()
    assert [(r.page_id, r.date, r.headline) for r in news] == [(8, dt.date(2024, 1, 2), "Up")]


def test_cards_by_selectors(spark):
    html = "<article><h2>no</h2><h1>Yes</h1></article><article></article><article class=x><h1>Two"
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = pages.extract_article_cards(frame, dt.date(2024, 1, 1), pages.CardLayout("article", "h1")).orderBy("row_idx").collect()
    assert [(r.row_idx, r.headline, r.time) for r in rows] == [(0, "Yes", "00:00"), (2, "Two", "00:00")]
