import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newstape.llm import bpe

ALPHABET = ["a", "B", "é", " ", "  ", "\t", "\n", "\x0b", "\r", "\x1c", "\x85", "\xa0", "　", "\x00", "'s", "'re", "1", "²", "!",
            "<|endoftext|>", "<|", "日本", "🙂", "​", "the ", "ing", "aaaa", "́"]


@pytest.fixture(scope="session")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def texts_of(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(14))) for _ in range(n)]


def test_ids_equal_the_library(vocabulary, library):
    texts = texts_of(1, 5000) + ["", "word " * 3000, "x" * 3000, "ab" * 700]
    ids, counts = bpe.encode_texts(pa.array(texts, pa.large_string()), bpe.load_vocabulary(vocabulary))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    wanted = library.encode_batch(texts, add_special_tokens=False)
    assert [p.tolist() for p in parts] == [w.ids for w in wanted]


def test_merge_rounds_take_overlapping_pairs_from_the_left(vocabulary, library):
    words = [b"aaaaa", b"aaaa", b"ababab", b"z"]
    ids, counts = bpe.merge_words(words, bpe.load_vocabulary(vocabulary))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_documents_and_their_digests(spark, frame, vocabulary, library):
    texts = [*texts_of(2, 200), None, "", "é" * 40_000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "no id")]
    got = bpe.digests(frame(rows), vocabulary).collect()
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(wanted, key=str)


def test_columns_stay_and_ids_decode_freely(spark, frame, vocabulary, library):
    docs = frame([(1, "some text")])
    coded = bpe.encode(docs, vocabulary)
    assert coded.columns == [*docs.columns, "ids"]
    back = bpe.decode(coded, vocabulary).select("text", "decoded").first()
    assert back.text == back.decoded
    odd = [[220, 50256, 0], [], None, [447], [447, 220, 999_999, -1]]
    rows = spark.createDataFrame([(i,) for i in odd], "ids array<int>")
    got = [r.decoded for r in bpe.decode(rows, vocabulary).collect()]
    assert got == [library.decode([x for x in i or [] if 0 <= x < 50257], skip_special_tokens=False) for i in odd]


def test_no_documents(frame, vocabulary):
    assert bpe.digests(frame([]).limit(0), vocabulary).collect() == []


def test_given_documents_come_back(spark, vocabulary, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    again = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    assert again.where(F.col("text") != F.col("decoded")).count() == 0
