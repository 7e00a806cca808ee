import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from newstape.llm import warc

ROWS = [
    (1, "http://b.a.org/x?q=1", "<p>one</p>"),
    (2, "http://a.org/", "<p>two</p>"),
    (3, "http://a.org/", "<p>one</p>"),
    (7, "http://c.org/é y\n\tz", "<p>one</p>"),
    (4, None, None),
    (5, "", ""),
    (6, "no scheme", "é" * 50_000),
    (6, "no scheme", "é" * 50_000),
    (None, "http://a.org/", "<p>two</p>"),
    (8, "http://z.org/", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = max(same) if same and len(data) >= least and page != max(same) else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if first is None else "revisit", first))
    return sorted(out, key=str)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, urlkey string, size int")


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, folder, least):
    pages = pages_of(spark, ROWS).repartition(3)
    captures = warc.write_archives(pages, folder, least)
    shards = warc.write_index(captures, folder, block_lines=2, shard_lines=3)
    keys = pages.select("page_id", warc.url_key(F.col("url")).alias("urlkey"))
    got = warc.read_captures(keys, folder, shards)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, least)


def test_index_finds_what_there_is(spark, folder):
    rows = [(i, f"http://h{i % 7}.org/{i % 50}", f"p{i}") for i in range(500)]
    captures = warc.write_archives(pages_of(spark, rows).repartition(4), folder)
    shards = warc.write_index(captures, folder, block_lines=5, shard_lines=60)
    assert len(shards) > 3
    wanted = spark.createDataFrame([("org,h3)/3", 3), ("org,h3)/3", 3), ("org,h3)/3", 4), ("zz)", 1), ("", 1)], "urlkey string, page_id long")
    assert [r.page_id for r in warc.read_captures(wanted, folder, shards).collect()] == [3]
    every = warc.read_captures(captures.select("urlkey", "page_id"), folder, shards)
    assert sorted(r.page_id for r in every.collect()) == list(range(500))


def test_no_pages(spark, folder):
    captures = warc.write_archives(pages_of(spark, ROWS).limit(0), folder)
    shards = warc.write_index(captures, folder)
    assert warc.read_captures(captures.select("urlkey", "page_id"), folder, shards).count() == 0


def test_records_parse_back():
    data = warc.record_bytes(9, "http://x/\r\ny", b"body", None)
    fields, block = warc.parse_record(data)
    assert fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://x/%0D%0Ay"
    assert block.endswith(b"\r\n\r\nbody") and data.endswith(b"\r\n\r\n")
