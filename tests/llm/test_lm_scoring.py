import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from newstape.llm import lm_scoring


def brute(rows, order, scale=2.0, power=0.9):
    counts = collections.Counter()
    words = {}
    for n, (_, text, held) in enumerate(rows):
        words[n] = [" s", *(text or "").encode().lower().split(), " e"]
        if not held:
            for k in range(1, order + 1):
                for i in range(len(words[n]) - k + 1):
                    counts[tuple(words[n][i : i + k])] += 1
    single = {k[0]: v for k, v in counts.items() if len(k) == 1 and k[0] != " s"}
    total, distinct = sum(single.values()), len(single)

    def prob(history, word):
        if not history:
            return (single.get(word, 0) + 1) / (total + distinct + 1)
        lower = prob(history[1:], word)
        seen = counts[history]
        if not seen:
            return lower
        t = scale * seen**power
        return (counts[(*history, word)] + t * lower) / (seen + t)

    out = []
    for n, (doc_id, _, held) in enumerate(rows):
        w = words[n]
        score = sum(math.log10(prob(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        base = sum(math.log10((single.get(x, 0) + 1) / (total + distinct + 1)) for x in w[1:])
        out.append((doc_id, held, len(w) - 1, sum(x in single for x in w[1:]), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "RANGE_KEYS", 500)
    draw = random.Random(order)
    vocabulary = ["the", "The", "of", "a", "é", "b\u00a0c", "x1", "end", "start"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(30))) for _ in range(40)]
    texts += [None, "", " \t\n ", " ".join(draw.choice(vocabulary) for _ in range(1500)), texts[0], texts[0]]
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)] + [(None, "the of", False), (0, texts[0], False)]
    docs = spark.createDataFrame([(*r, "en", 3) for r in rows], "doc_id long, text string, held_out boolean, lang string, block int")
    got = lm_scoring.score_documents(docs, order=order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: tuple((v is None, v) for v in r[:3]) + tuple(round(v, 6) for v in r[5:])
    got = sorted((tuple(r) for r in got.select(names).collect()), key=key)
    wanted = sorted(brute(rows, order), key=key)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_without_training_or_rows(spark):
    schema = "doc_id long, text string, held_out boolean"
    only = lm_scoring.score_documents(spark.createDataFrame([(1, "a b", True)], schema)).collect()
    assert only[0].train_tokens == 0 and only[0].n_known == 0 and only[0].score == only[0].base_score == 0.0
    assert lm_scoring.score_documents(spark.createDataFrame([], schema)).collect() == []


def test_fold_is_the_crc_of_the_id(spark):
    found = spark.range(200).select("id", lm_scoring.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in found)


def test_held_out_texts_score_better_than_single_words(spark, sf_dir):
    scored = lm_scoring.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out")
    row = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b * 0.95
