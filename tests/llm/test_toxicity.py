import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newstape.llm import toxicity

BAD = ["zanker", "zankolo", "brutok"]


def brute_marginals(emissions, transitions):
    """All tag sequences of one text; the word before it is tagged 0."""
    n = len(emissions)
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        before = (0, *tags[:-1])
        weight = np.exp(sum(emissions[i] * t + transitions[b, t] for i, (b, t) in enumerate(zip(before, tags))))
        total += weight
        ones += weight * np.array(tags)
        for b, t in zip(before, tags):
            pairs[b, t] += weight
    return ones / total, pairs / total, np.log(total)


def case(seed, most=9):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(0, most, 6)
    return draw.normal(0, 2, lengths.sum()), np.concatenate([[0], np.cumsum(lengths)]), draw.normal(0, 1, (2, 2))


@pytest.mark.parametrize("row", [1, 2, 5, 256])
def test_marginals_equal_all_sequences(monkeypatch, row):
    monkeypatch.setattr(toxicity, "ROW", row)
    for seed in range(8):
        emissions, offsets, transitions = case(seed)
        marginals, alpha, beta = toxicity.chain(emissions, offsets, transitions)
        wanted = [brute_marginals(emissions[lo:hi], transitions) for lo, hi in zip(offsets[:-1], offsets[1:])]
        assert np.allclose(marginals, np.concatenate([w[0] for w in wanted]))
        pairs = toxicity.expected_transitions(emissions, offsets, transitions, alpha, beta)
        assert np.allclose(pairs, sum(w[1] for w, lo, hi in zip(wanted, offsets[:-1], offsets[1:]) if hi > lo))


def test_gradient_is_that_of_the_likelihood():
    emissions, offsets, transitions = case(5, 6)
    n = len(emissions)
    draw = np.random.default_rng(1)
    tags = draw.integers(0, 2, n).astype(float)
    slots = np.stack([np.arange(n), np.full(n, toxicity.SLOTS + 1)], 1)
    weights = np.zeros(toxicity.SLOTS + 1)
    weights[:n] = emissions

    def likelihood(e, t):
        total = 0.0
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            own = tags[lo:hi].astype(int)
            total += sum(e[lo + i] * y + t[b, y] for i, (b, y) in enumerate(zip([0, *own[:-1]], own)))
            total -= brute_marginals(e[lo:hi], t)[2]
        return total

    got, got_t = toxicity.gradient(slots, np.arange(n), offsets, tags, toxicity.Tagger(weights, transitions))
    for i in range(n):
        step = np.eye(n)[i] * 1e-5
        assert got[i] == pytest.approx((likelihood(emissions + step, transitions) - likelihood(emissions - step, transitions)) / 2e-5, abs=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert got_t[a, b] == pytest.approx((likelihood(emissions, transitions + step) - likelihood(emissions, transitions - step)) / 2e-5, abs=1e-4)
    assert got[toxicity.SLOTS] == pytest.approx(got[:n].sum())


def test_features_ignore_case_and_outer_marks():
    words = pa.array([b"zanker", b"(zanker),", b"zank", b"...", b"\xc3\xa9t\xc3\xa9"], pa.large_binary())
    found = toxicity.feature_slots(words)
    assert (found[0] == found[1]).all() and (found[3] == 0).all()
    assert len({*found[0].tolist()} & {*found[2].tolist()}) > 1


@pytest.fixture(scope="module")
def planted(spark, frame):
    draw = random.Random(2)
    words = ["".join(draw.choice("aeioustrn") for _ in range(draw.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [draw.choice(words) for _ in range(draw.randrange(5, 120))]
        bad = i % 8 == 0
        for _ in range(3 * bad):
            text.insert(draw.randrange(len(text)), draw.choice(BAD) + draw.choice(["", "an", "ist", "e!", "os,"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    odd = [(5000, None), (5001, ""), (5002, " \n "), (None, "zankerist"), (5003, "nice " * 40_000 + "zankeran, brutok zankoloist"), (0, rows[0][1])]
    labels += [(None, 0, 1), (5, 0, None), (7, 0, 2), (5001, 1, 0)]
    return frame(rows + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_planted_words_are_learned_and_located(spark, planted):
    docs, labels, rows = planted
    model = toxicity.learn(docs, labels)
    scored = toxicity.score_documents(docs, model).withColumn("held_out", toxicity.held_out())
    got = scored.where("doc_id < 5000 and held_out").collect()
    assert len(got) > 250
    assert all((r.score >= toxicity.TOXIC) == (r.doc_id % 8 == 0) for r in got)
    texts = dict(rows)
    for r in got:
        found = [texts[r.doc_id][s.start : s.end] for s in r.spans]
        assert all(any(w.startswith(tuple(BAD)) for w in f.split()) for f in found)
        assert bool(found) == (r.doc_id % 8 == 0)
    odd = {r.doc_id: r for r in scored.where("doc_id >= 5000").collect()}
    assert all((odd[i].words, odd[i].expected, odd[i].spans) == (0, 0.0, []) and 0 <= odd[i].score < 0.5 for i in (5000, 5001, 5002))
    assert [(s.start, s.end) for s in odd[5003].spans] == [(200_000, 200_027)]
    assert scored.count() == docs.count() and scored.where("score not between 0 and 1 or score is null").count() == 0
    same = scored.where("doc_id = 0").collect()
    assert len(same) == 2 and same[0].score == pytest.approx(same[1].score)


def test_labels_teach_only_outside_the_held_out_part(spark, planted):
    docs, labels, _ = planted
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, wrong)
    assert np.allclose(one.tagger.weights, two.tagger.weights, atol=1e-4) and one.weights == pytest.approx(two.weights, rel=1e-3)


def test_copies_count_once(spark, frame):
    rows = [(i, "the same rude words over and over again " + str(i % 2)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    sample = toxicity.sample_texts(frame(rows), toxicity.known_labels(labels))
    assert sample.count() <= 2


def test_nothing_to_learn_from(spark, frame):
    docs = frame([(1, "a"), (2, None)])
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = toxicity.learn(docs, given)
        assert model is None
        assert [(r.score, r.spans) for r in toxicity.score_documents(docs, model).collect()] == [(0.5, [])] * 2
    assert toxicity.learn(docs.limit(0), labels.withColumn("toxic", F.col("doc_id").cast("int") - 1)) is None


def test_held_out_accuracy_on_given_documents(spark, sf_dir):
    folder = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    scored = toxicity.op13_toxicity(spark, folder)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rated = scored.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    row = rated.selectExpr(
        "count_if(toxic = 1 and predicted = 1) hits", "count_if(toxic = 1) toxic",
        "count_if(toxic = 0 and predicted = 1) wrong", "count_if(toxic = 0) clean",
    ).first()
    assert row.hits >= 0.8 * row.toxic and row.wrong <= 0.01 * row.clean, row


def test_every_document_of_the_smallest_table_has_a_row(spark, sf_dir):
    out = toxicity.op13_toxicity(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
