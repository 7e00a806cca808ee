import itertools
import pickle
import random

import numpy as np
import pytest

from newstape.operators import entities, tagger
from newstape.sources import views


def test_decoding_equals_all_sequences():
    """Random weights, texts of up to four words."""
    draw = np.random.default_rng(5)
    model = tagger.Tagger(["ORG", "GPE"])
    for words in (["a"], ["a", "B"], ["x1", "y", "Z"], ["a", "a", "b", "C"]):
        n, t = len(words), len(model.tags)
        model.steps = draw.normal(size=(t, t))
        scores = draw.normal(size=(n, t))
        best, found = -np.inf, None
        for path in itertools.product(range(t), repeat=n):
            if not model.starts[path[0]] or not all(model.allowed[a, b] for a, b in zip(path, path[1:])):
                continue
            total = scores[range(n), path].sum() + sum(model.steps[a, b] for a, b in zip(path, path[1:]))
            if total > best:
                best, found = total, list(path)
        assert model._best(scores) == found
    assert model.decode([]) == [] and model("") == []


def test_many_texts_at_once_equal_one_by_one(monkeypatch):
    draw = np.random.default_rng(8)
    pick = random.Random(8)
    model = tagger.Tagger(["ORG", "GPE"])
    model.steps = draw.normal(size=model.steps.shape)
    names = sorted({f for w in "a b C d1 _e".split() for f in tagger.own_features(w) + tagger.near_features(w, "left") + tagger.near_features(w, "right")})
    model.rows = {n: i for i, n in enumerate([*names, "left!", "right!"])}
    model.weights = draw.normal(size=(len(model.rows), len(model.tags)))
    texts = [" ".join(pick.choice("a b C d1 new".split()) for _ in range(pick.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
    alone = []
    for text in texts:
        words, last = tagger.words_of(text), {}
        for i, j, kind in tagger.spans(model.decode(words)):
            last.pop(" ".join(words[i:j]), None)
            last[" ".join(words[i:j])] = kind
        alone.append(list(last.items()))
    for at_once in (10, 10**6):
        monkeypatch.setattr(tagger, "WORDS_AT_ONCE", at_once)
        assert list(model.many(texts)) == alone
    assert sum(map(len, alone)) > 100


def test_scores_of_words_come_from_one_lookup_a_kind(monkeypatch):
    """Scores equal the sums over a word's own features and are made for all new words at once, forgotten tables included."""
    draw = np.random.default_rng(3)
    model = tagger.Tagger(["ORG", "GPE"])
    words = ["Acme", "acme", "ÉTÉ", "x-1", "A&B", "new", "Acme"]
    seen = words[:4]
    names = sorted({f for w in seen for f in tagger.own_features(w) + tagger.near_features(w, "left") + tagger.near_features(w, "right")})
    model.rows = {n: i for i, n in enumerate([*names, "left!", "right!"])}
    model.weights = draw.normal(size=(len(model.rows), len(model.tags)))

    def total(features):
        return model.weights[[model.rows[f] for f in features if f in model.rows]].sum(axis=0)

    ends = [None, *words, None]
    expected = [total(tagger.near_features(ends[i], "left")) + total(tagger.own_features(w)) + total(tagger.near_features(ends[i + 2], "right")) for i, w in enumerate(words)]
    calls = []
    monkeypatch.setattr(tagger.Tagger, "_weights_of", lambda self, kind, values, f=tagger.Tagger._weights_of: calls.append(kind) or f(self, kind, values))
    for _ in range(2):
        assert np.array_equal(model.emissions([words]), np.array(expected))
        model._forget()
    assert len(calls) == 2 * (3 + 2 + len(tagger.OWN) + 1)  # however many words there are
    again = pickle.loads(pickle.dumps(model))
    assert np.array_equal(again.emissions([words]), np.array(expected))


def test_longest_names_from_the_left():
    names = {("of", "the"): "ORG", ("the",): "GPE", ("the", "new", "deal"): "LOC"}
    tags = tagger.label_words("of the new deal the the new deal".split(), names)
    assert tags == ["B-ORG", "I-ORG", "O", "O", "B-GPE", "B-LOC", "I-LOC", "I-LOC"]
    assert tagger.spans(tags) == [(0, 2, "ORG"), (4, 5, "GPE"), (5, 8, "LOC")]
    assert tagger.spans(["I-ORG", "O", "B-LOC", "B-LOC"]) == [(2, 3, "LOC"), (3, 4, "LOC")]


def made_texts(spark, n=400, known=True, seed=2):
    """Names of firms end in Corp or Bank, places follow 'in'; the gazetteer has half of the names, the texts have those or the others."""
    draw = random.Random(2)
    stems = ["".join(draw.choice("bdklmnrst") + draw.choice("aeiou") for _ in range(3)).title() for _ in range(120)]
    small = "shares fell after profits rose and the market said analysts expect more growth this year".split()
    draw, rows = random.Random(seed), []
    used = stems[:60] if known else stems[60:]
    for i in range(n):
        words = [draw.choice(small) for _ in range(draw.randrange(4, 14))]
        words[draw.randrange(len(words))] = draw.choice(used) + draw.choice([" Corp", " Bank"])
        words.append("in " + draw.choice(used) + "ville")
        rows.append((i, " ".join(words) + "."))
    listed = [(f"{s} {end}", "ORG") for s in stems[:60] for end in ("Corp", "Bank")] + [(f"{s}ville", "GPE") for s in stems[:60]]
    texts = spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "?!")], "doc_id long, headline string")
    return texts, spark.createDataFrame(listed, "entity string, entity_type string"), stems


def test_names_that_the_gazetteer_lacks_are_found(spark):
    texts, names, stems = made_texts(spark)
    model = tagger.train_tagger(texts, names)
    others, _, _ = made_texts(spark, known=False, seed=3)
    found = entities.extract_entities(others, load_model=lambda: model, keep=()).collect()
    lists = {f"{s} {end}" for s in stems[60:] for end in ("Corp", "Bank")}, {f"{s}ville" for s in stems[60:]}
    new = [r for r in found if r.entity in lists[0] | lists[1]]
    assert len(new) > 0.9 * 2 * 400 and all(r.entity_type == ("ORG" if r.entity in lists[0] else "GPE") for r in new)


def test_without_names_or_texts_nothing_is_found(spark):
    texts, names, _ = made_texts(spark, 5)
    for t, n in ((texts.limit(0), names), (texts, names.limit(0)), (texts.where("headline is null"), names)):
        model = tagger.train_tagger(t, n)
        assert entities.extract_entities(texts, load_model=lambda: model, keep=()).count() == 0


def test_held_out_pieces_of_the_given_texts(spark, sf_dir):
    texts = views.texts(spark, sf_dir)
    model = tagger.train_tagger(texts, views.gazetteer(spark))
    assert model.f1 > 0.97
    said = {tuple(r) for r in entities.extract_entities(texts, load_model=lambda: model, keep=()).collect()}
    rule = {tuple(r) for r in entities.extract_entities(texts, gazetteer=views.gazetteer(spark), keep=()).collect()}
    names = {e for e in rule if e[2] in ("ORG", "GPE", "PERSON", "LOC", "PRODUCT")}
    assert len(said & names) > 0.9 * len(said)
