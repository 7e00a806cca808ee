import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstape.operators import series_models


def newton(x, y, s, c=1.0):
    """A model by itself: plain Newton with halved steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1] - 1, 1 / c), 0)
    w = np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return (s * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (s * (p - y)) + penalty * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-14:
            step /= 2
        w = w - step
    return w


def series_rows(seed, tickers=("a", "b", None, "hot"), n=60):
    draw = random.Random(seed)
    rows = []
    for t in tickers:
        slope = draw.uniform(-3, 3)
        for _ in range(n * (20 if t == "hot" else 1)):
            x, z = draw.gauss(0, 1), draw.gauss(2, 5)
            rows.append((t, x, z, int(draw.random() < 1 / (1 + math.exp(-slope * x + 0.2 * z))), draw.uniform(0.5, 2)))
    return rows


KINDS = "ticker string, x double, z double, target int, s double"


@pytest.mark.parametrize("weight", [None, "s"])
def test_every_series_gets_its_own_optimum(spark, weight):
    rows = series_rows(1)
    models = {r.ticker: r for r in series_models.fit_logistic(spark.createDataFrame(rows, KINDS), ["x", "z"], weight=weight).collect()}
    assert set(models) == {"a", "b", None, "hot"}
    for t, model in models.items():
        own = np.array([r[1:] for r in rows if r[0] == t], float)
        wanted = newton(own[:, :2], own[:, 2], own[:, 3] if weight else np.ones(len(own)))
        assert np.allclose(model.weights, wanted, atol=1e-6) and model.gradient < 1e-6 and model.rows == len(own)


def test_separable_and_one_sided_series(spark):
    rows = [("sep", float(i), 0.0, int(i > 5), 1.0) for i in range(12)] + [("up", float(i), 1.0, 1, 1.0) for i in range(5)]
    rows += [("flat", 3.0, 3.0, i % 2, 1.0) for i in range(8)] + [("gap", None, 1.0, 1, 1.0), ("huge", 1e6, 1.0, 1, 1.0), ("huge", -1e6, 1.0, 0, 1.0)]
    frame = spark.createDataFrame(rows, KINDS)
    found = series_models.fit_logistic(frame, ["x", "z"])
    models = {r.ticker: r for r in found.collect()}
    assert models["up"].weights is None and models["up"].positives == 5 and "gap" not in models
    assert models["sep"].gradient < 1e-6 and models["sep"].weights[0] > 0
    assert models["flat"].gradient < 1e-6
    scored = series_models.predict_logistic(frame, found, ["x", "z"])
    got = {(r.ticker, r.x): (r.probability, r.prediction) for r in scored.collect()}
    assert got["up", 2.0] == (1.0, 1) and got["gap", None] == (None, None)
    assert all(got["sep", float(i)][1] == int(i > 5) for i in range(12)) and scored.count() == len(rows)


def bars(spark, tickers, n):
    draw = random.Random(4)
    rows = []
    for t in tickers:
        for i in range(n):
            close = 50 + 10 * math.sin(i / 3) + draw.gauss(0, 1)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(days=i), close - 0.5, close + 1, close - 1, close, 100 + i % 7))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")


def scores(spark, tickers, n):
    draw = random.Random(9)
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=i), draw.uniform(-1, 1), 3) for t in tickers for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, sentiment_score double, headline_count long")


def test_training_by_series_equals_training_alone(spark):
    b, s = bars(spark, ["a", None], 80), scores(spark, ["a", None], 80)
    both = series_models.train_by_series(b, s, ["close", "sentiment_score"])
    alone = series_models.train_by_series(b.where("ticker = 'a'"), s, ["close", "sentiment_score"])
    weights = {r.ticker: r.weights for r in both["models"].collect()}
    assert set(weights) == {"a", None}
    assert weights["a"] == pytest.approx(alone["models"].first().weights, abs=1e-7)
    quality = {r.ticker: r.accuracy for r in both["results"].collect()}
    hits = both["predictions"].groupBy("ticker").agg(F.avg((F.col("prediction") == F.col("target")).cast("int"))).collect()
    assert quality == {r[0]: pytest.approx(r[1]) for r in hits}
    assert series_models.train_by_series(b, s, ["close"], least_rows=1000)["results"].count() == 0


@pytest.mark.parametrize("scope", ["all", "train"])
def test_validation_by_series(spark, scope):
    b, s = bars(spark, ["a", "b", None], 70), scores(spark, ["a", "b", None], 70)
    short = bars(spark, ["short"], 20)
    out = series_models.cross_validate_by_series(b.unionByName(short), s, folds=3, fit_scope=scope, least_train=18)
    folds = out["folds"].collect()
    assert len(folds) == 9 and {r.ticker for r in folds} == {"a", "b", None}
    assert all((r.accuracy is None) == (r.train_rows < 18) for r in folds)
    assert out["importance"].count() == 3 * len(series_models.FEATURES)
    for r in out["summary"].collect():
        own = [f.accuracy for f in folds if f.ticker == r.ticker and f.accuracy is not None]
        assert r.avg_accuracy == pytest.approx(sum(own) / len(own))


def test_best_model_of_each_series(spark):
    rows = [("a", "m1", 0.5, 0), ("a", "m2", 0.5, 1), (None, "m1", 0.2, 0), (None, "m2", 0.3, 1)]
    frame = spark.createDataFrame(rows, "ticker string, model_name string, f1 double, train_order int")
    assert {r.ticker: r.model_name for r in series_models.best_by_series(frame).collect()} == {"a": "m1", None: "m2"}
