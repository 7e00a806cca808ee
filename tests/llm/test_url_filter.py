import pytest

from newstape.llm import url_filter

CASES = [
    # url, host, path, rule, verdict
    ("https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    ("http://x.com?/de/", "x.com", "", None, "allow"),
    ("http://x.net/a", "x.net", "/a", None, "block"),
    ("https://u@X.net:443/a/?utm_source=q#f", "u@x.net:443", "/a/", None, "block"),
    ("http://x.net/a?b=1", "x.net", "/a", None, "allow"),
    ("x.net/a", "", "", None, "allow"),
    ("http:///a", "", "/a", None, "allow"),
    ("a://b://c", "b:", "//c", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def pages_of(spark, urls):
    rows = [(i, u, "h", "other") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, canonical string")


def test_rules_list_and_odd_urls(spark):
    pages = pages_of(spark, [c[0] for c in CASES])
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), (None,), ("nowhere/",)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_repeated_and_missing_rows(spark):
    pages = pages_of(spark, ["http://x.net/a"] * 3)
    listed = spark.createDataFrame([], "canonical string")
    assert [r.verdict for r in url_filter.judge(pages, listed).collect()] == ["allow"] * 3
    assert url_filter.judge(pages_of(spark, []).limit(0), listed).count() == 0


def test_list_behind_a_full_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    listed = spark.range(3000).selectExpr("concat('h.net/', id * 2) as canonical")
    pages = spark.range(6000).selectExpr("id as page_id", "concat('http://h.net/', id) as url")
    got = url_filter.judge(pages, listed).selectExpr("page_id % 2 as odd", "verdict").distinct().collect()
    assert {tuple(r) for r in got} == {(0, "block"), (1, "allow")}


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("HTTP://WWW.A.de:80/x//?ref=1&b=2&a=1", "www.a.de/x?a=1&b=2"),
        ("https://a.de", "a.de"),
        ("https://a.de/?utm_medium=1#top", "a.de"),
        ("mailto:x", None),
    ],
)
def test_canonical_url(spark, url, canonical):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(url_filter.canonical_url(F.col("u"))).first()[0] == canonical
