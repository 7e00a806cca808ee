import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from newstape.functions import dates, display, text
from newstape.functions.lexicon import FINANCE_TERMS, finance_lexicon, lexicon_table
from newstape.functions.scoring import lookup_in, score_expr
from newstape.operators import sentiment


def values(spark, inputs, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_text(spark):
    inputs = ["AAPL Beats Q3 — see https://x.co/a now!", "awwwful day", "Don't  panic", "café bar", None, "a\tb\nc\x1cd"]
    assert values(spark, inputs, text.clean_text) == [
        "aapl beats q3 see now!", "a day", "dont panic", "caf bar", "", "a b c d",
    ]
    assert values(spark, ["  Keep\n Case & é  ", None], text.clean_text_light) == ["Keep Case & é", ""]


def test_words(spark):
    assert values(spark, ['He said "good"! :) ok, (x)', ""], text.words_of) == [
        ["He", "said", "good", ":)", "ok,", "(x)"], [],
    ]


def test_news_dates(spark):
    ref = dt.date(2024, 3, 15)
    inputs = ["Today", "Yesterday", "May-01-23", "May-01", "May-01-2023", "n/a", None, "may-31-95", "Feb-30-23"]
    assert values(spark, inputs, lambda c: dates.parse_news_date(c, ref)) == [
        ref, dt.date(2024, 3, 14), dt.date(2023, 5, 1), dt.date(2024, 5, 1), None, None, None, dt.date(1995, 5, 31), None,
    ]
    inputs = [" TODAY ", "2023-05-01", "n/a", "yesterday", "2023-05-01 10:00:00", "05/31/2023", "May-31-23", "12:45PM"]
    assert values(spark, inputs, lambda c: dates.fix_dates(c, ref)) == [
        ref, dt.date(2023, 5, 1), ref, dt.date(2024, 3, 14), dt.date(2023, 5, 1), dt.date(2023, 5, 31), dt.date(2023, 5, 31), ref,
    ]
    inputs = ["2023-05-01T10:00:00", "2023-05-01", "", "x", None]
    assert values(spark, inputs, dates.parse_date_input) == [dt.date(2023, 5, 1)] * 2 + [None] * 3


def test_cells(spark):
    inputs = ["May-31-23 12:45PM", "12:45PM", "May-31-23 12:45PM EST"]
    assert [tuple(v) for v in values(spark, inputs, dates.split_datetime_cell)] == [
        ("May-31-23", "12:45PM"), (None, "12:45PM"), ("May-31-23", "12:45PM"),
    ]
    assert [tuple(v) for v in values(spark, inputs, lambda c: dates.split_datetime_cell(c, "strict"))][2] == (None, "May-31-23")
    assert [tuple(v) for v in values(spark, inputs, lambda c: dates.split_datetime_cell(c, "page"))][1] == ("12:45PM", "N/A")
    ref = dt.date(2024, 3, 15)
    inputs = ["May-31-23 12:45PM", "09:05am", "Today 01:00PM", "junk", "May-99-23 01:00PM"]
    assert [tuple(v) for v in values(spark, inputs, lambda c: dates.parse_cell_time(c, ref))] == [
        (dt.date(2023, 5, 31), "12:45"), (None, "09:05"), (ref, "13:00"), (None, None), (None, None),
    ]


def test_categories_and_display(spark):
    assert values(spark, [0.05, -0.05, 0.0499, None], text.sentiment_category, "double") == [
        "Positive", "Negative", "Neutral", "Neutral",
    ]
    assert values(spark, [1234.567, -5.0], display.money, "double") == ["$1234.57", "$-5.00"]
    assert values(spark, [-0.00001, 0.25, None], display.score_text, "double") == ["0.0000", "0.2500", "N/A"]
    assert values(spark, [1234567, None, 0], display.count_text, "bigint") == ["1,234,567", "0", "0"]
    assert display.header_title("sentiment_score") == "Sentiment Score"


def scores(spark, inputs, lexicon, **kw):
    out = values(spark, inputs, lambda c: score_expr(c, lookup_in(lexicon), **kw))
    return [(r.compound, r.pos, r.neu, r.neg) for r in out]


def test_unigram_golden(spark):
    got = scores(spark, ["profit gains", "stock profit decline", "stock moves", ""], FINANCE_TERMS)
    assert got == [(0.5423, 1.0, 0.0, 0.0), (0.128, 0.455, 0.182, 0.364), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    assert scores(spark, [""], FINANCE_TERMS, empty_neutral=1.0) == [(0.0, 0.0, 1.0, 0.0)]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize(
    "sentence,total",
    [
        ("very good", 1.9 + 0.293),
        ("very bad", -2.5 - 0.293),
        ("hardly good", 1.9 - 0.293),
        ("very nice good", 1.8 + 0.293 + 1.9 + 0.293 * 0.95),
        ("not good", 1.9 * -0.74),
        ("not very good", (1.9 + 0.293) * -0.74),
        ("not at all good", 1.9 * -0.74),
        ("it isn't good", 1.9 * -0.74),
        ("never so good", (1.9 + 0.293) * 1.25),
        ("without doubt good", 1.9),
        ("least good", 1.9 * -0.74),
        ("at least good", 1.9),
        ("GOOD day", 1.9 + 0.733),
        ("GOOD", 1.9),
        ("VERY good", 1.9 + 0.293 + 0.733),
        ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
        ("good!!", 1.9 + 2 * 0.292),
        ("bad!!!!!!", -2.5 - 4 * 0.292),
        ("good??", 1.9 + 2 * 0.18),
        ("good????", 1.9 + 0.96),
        ("kind of good", 1.9),
    ],
)
def test_context_rules(spark, sentence, total):
    lexicon = {"good": 1.9, "nice": 1.8, "bad": -2.5, "kind": 2.4}
    assert scores(spark, [sentence], lexicon)[0][0] == pytest.approx(compound(total), abs=1.1e-4)


def test_phrases(spark):
    df = spark.createDataFrame([("a strong buy today",)], "headline string")
    plain = sentiment.score_news(df).first()
    pairs = sentiment.score_news(df, match_phrases=True).first()
    assert plain.sentiment_compound == compound(1.0)
    assert pairs.sentiment_compound == compound(3.0)  # the pair and its second word


def test_table_path_equals_list_path(spark):
    rows = [
        (1, "Profit beats, NOT a loss! but probe looms", 7),
        (2, "", 7),
        (3, "very bullish growth??", 7),
        (4, "nothing here", 7),
        (5, None, 7),
        (5, "Profit beats", 8),
        (5, "Profit beats", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id int, headline string, term int").withColumn("cleaned_text", text.clean_text("headline"))
    terms = {**FINANCE_TERMS, "Profit": 0.1, "PROBE": -9.0, "here nothing": 1.0, "nothing here": -2.0}
    table = spark.createDataFrame([*terms.items(), ("loss", None), (None, 1.0)], "term string, valence double")
    for options in ({}, {"rules": False, "empty_neutral": 1.0}, {"match_phrases": True}, {"lower_case": True}):
        a = sentiment.lexicon_score(df, terms, **options)
        b = sentiment.lexicon_score_table(df, table, **options)
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_terms_that_differ_in_case_only(spark):
    terms = {"Good": 1.0, "GOOD": -1.0, "good": 0.5, "Bad": -2.0, "bad": 1.5}
    assert sentiment.normalized_terms(terms) == {"good": 1.0, "bad": -2.0}
    table = spark.createDataFrame(list(terms.items()), "term string, valence double")
    assert {r.term: r.valence for r in sentiment.normalized_lexicon(table).collect()} == {"good": 1.0, "bad": -2.0}


def test_table_path_reads_the_texts_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "profit")], "doc_id int, cleaned_text string").write.parquet(path)
    plan = sentiment.lexicon_score_table(spark.read.parquet(path), lexicon_table(spark))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Scan parquet") == plan.toString().count("FileScan parquet") == 1


def test_large_inline_lexicon(spark):
    lexicon = {f"w{i}": (i % 80 - 40) / 10 for i in range(12000)} | {"good": 1.9}
    assert scores(spark, ["not good w41"], lexicon)[0][0] == pytest.approx(compound(1.9 * -0.74 + 0.1 * -0.74), abs=1e-4)


def test_lexicon_layers(spark):
    base = lexicon_table(spark, {"buy": -9.0, "good": 1.9})
    merged = {r.term: r.valence for r in finance_lexicon(spark, base).collect()}
    assert len(FINANCE_TERMS) == 43 and len(merged) == 44 and merged["buy"] == 1.0


def test_topics(spark):
    df = spark.createDataFrame([(1, "Stock rises; the stock falls 3abc abc"), (2, None)], "doc_id int, headline string")
    got = [(r.word, r.occurrences) for r in sentiment.extract_topics(df, 10).collect()]
    assert got == [("stock", 2), ("rises", 1), ("falls", 1), ("abc", 1)]


def test_long_text_is_linear(spark):
    body = " ".join(["profit", "and", "loss", "of", "words"] * 20000)
    df = spark.createDataFrame([(body,)], "headline string")
    row = sentiment.score_news(df).first()
    assert row.sentiment_neutral == pytest.approx(3 / (3 + 2 * 2.5), abs=1e-3)
    assert re.sub(r"\s", "", body)[:6] == "profit"
