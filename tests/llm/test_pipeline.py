import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newstape.llm import decontaminate, quality
from tests.llm.test_simhash import brute as same_group
from tests.llm.test_suffix_dedup import brute as without_repeats


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The rows of every stage, each made from what the one before stored."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append(docs := spark.read.parquet(path))
    return out


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir, stored, vocabulary):
    assert len(corpus_pipeline.STAGES) == 5
    docs = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ranking = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    strength = quality.features_of(pa.array([t for _, t in docs], pa.large_string())) @ np.array(ranking.weights)
    kept = [d for d, s in zip(docs, strength) if s >= ranking.threshold]
    assert rows_of(stored[0]) == kept

    least = {c for _, _, c in same_group(kept)}
    kept = [d for d in kept if d[0] in least]
    assert rows_of(stored[1]) == kept

    left = {r[0]: r[5].decode("utf-8", "ignore") for r in without_repeats(kept)}
    kept = [(i, left[i]) for i, t in kept if left[i] or not t]
    assert rows_of(stored[2]) == kept

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words, counts = decontaminate.plain_words(pa.array(items, pa.large_string()))
    items = np.split(words.view(np.int64), np.cumsum(counts)[:-1])
    clean = []
    for i, t in kept:
        own = decontaminate.plain_words(pa.array([t], pa.large_string()))[0].view(np.int64)
        score, _, _ = decontaminate.align(items, [own] * len(items)) if len(own) else ([0], 0, 0)
        if all(s / (decontaminate.MATCH * len(x)) < decontaminate.THRESHOLD for s, x in zip(score, items)):
            clean.append((i, t))
    assert rows_of(stored[3]) == clean
    for frame in stored[:4]:
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS

    library = Tokenizer.from_file(vocabulary)
    got = sorted(tuple(r) for r in stored[4].collect())
    wanted = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == wanted


def test_run_gives_the_last_stage(spark, sf_dir, stored):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stored[4].collect()))


def test_labelled_clean_documents_stay(spark, sf_dir, stored):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert labels.where("quality = 1").join(stored[0], "doc_id", "left_anti").count() <= 1
    assert labels.where("quality = 0").join(stored[0], "doc_id").count() <= 1


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


ODD = [(1, None, "en"), (2, "", None), (3, "one two three four", "en"), (3, "one two three four", "en"), (None, "no id at all here", "en"),
       (None, "no id at all here", None), (4, "word " * 60_000, "en"), (5, " \n\t", "de"), (6, "a text without copies or passages", "fr")]


@pytest.mark.parametrize("number", range(5))
@pytest.mark.parametrize("columns", ["all", "two", "clash"])
def test_stages_take_odd_rows(spark, sf_dir, number, columns):
    """Nulls, empty and very long texts, repeated rows, rows without id, missing and clashing columns."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    if columns == "two":
        docs = docs.select("text", "doc_id")
    if columns == "clash":
        names = ("block", "fp", "component_id", "features", "_key", "_kept", "ids", "decoded", "score", "rest", "unit")
        docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, sf_dir)
    rows = out.collect()
    if number < 4:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
    if number in (0, 3, 4):  # equal rows stay or go together
        assert sum(r.doc_id == 3 for r in rows) in (0, 2) and sum(r.doc_id is None for r in rows) in (0, 2)
    if number == 3:
        assert len(rows) == len(ODD)
    if number == 4:
        empty = hashlib.sha256(b"").hexdigest()
        assert len(rows) == len(ODD) and {(r.n_tokens, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, empty)}
    if number == 1:
        kept = sorted(str(r.doc_id) for r in rows)
        assert kept == ["1", "3", "3", "4", "6", "None", "None"]  # 1 stands for all texts without words
