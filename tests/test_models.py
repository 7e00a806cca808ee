import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newstape.operators import backtest, modeling
from newstape.sources import models


@pytest.fixture(scope="module")
def tape(spark):
    """Two tickers whose next move follows the day's score, with some noise."""
    rng = np.random.default_rng(11)
    bars, scores = [], []
    for ticker in ("A", "B"):
        score = rng.normal(0, 0.4, 260).clip(-1, 1)
        move = 0.02 * np.sign(score + rng.normal(0, 0.1, 260))
        close = 100 * np.exp(np.r_[0, np.cumsum(move[:-1])])
        days = [dt.date(2022, 1, 3) + dt.timedelta(days=i) for i in range(260)]
        bars.append(pd.DataFrame({"ticker": ticker, "date": days, "open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(100, 999, 260)}))
        scores.append(pd.DataFrame({"ticker": ticker, "date": days, "sentiment_score": score, "headline_count": 3}))
    return spark.createDataFrame(pd.concat(bars)), spark.createDataFrame(pd.concat(scores))


def test_prepare_data(tape):
    rows, features = modeling.prepare_data(*tape)
    assert features == ["open", "high", "low", "close", "volume", "sentiment_score"]
    counts = {(r.ticker, r.role): r.n for r in rows.groupBy("ticker", "role").agg(F.count("*").alias("n")).collect()}
    assert counts == {(t, r): n for t in "AB" for r, n in (("train", 207), ("test", 52))}
    stats = rows.where("role='train'").groupBy("ticker").agg(F.avg("volume").alias("m"), F.stddev_pop("volume").alias("s"))
    for r in stats.collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)


def test_logistic_regression_finds_the_signal(tape):
    rows, features = modeling.prepare_data(*tape)
    rows = rows.cache()
    train, test = rows.where("role='train'"), rows.where("role='test'")
    model = modeling.train_logistic_regression(train, features)
    weights = dict(zip(features, model.stages[-1].coefficients.toArray()))
    assert weights["sentiment_score"] > 1 and max(weights, key=lambda k: abs(weights[k])) == "sentiment_score"
    quality = modeling.evaluate_model(model, test).first()
    assert quality.accuracy > 0.8 and 0 <= quality.f1 <= 1
    again = modeling.train_logistic_regression(train, features, balanced=True)
    assert modeling.evaluate_model(again, test).first().accuracy > 0.8
    scored = modeling.predict(model, test)
    assert scored.where("probability < 0 or probability > 1").count() == 0
    returns, report = backtest.backtest_model(scored, price="price")
    assert returns.count() == test.count()
    assert report.where("total_return > 0").count() == 2
    rows.unpersist()


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_regression_minimises_the_penalised_loss(tape, balanced):
    """At the optimum of C * sum(loss) + |w|^2 / 2 the gradient vanishes."""
    rows, features = modeling.prepare_data(*tape)
    train = rows.where("role='train'").cache()
    model = modeling.train_logistic_regression(train, features, c=2.0, balanced=balanced).stages[-1]
    pdf = train.select(*features, "target").toPandas()
    x, y, w = pdf[features].to_numpy(), pdf.target.to_numpy(), model.coefficients.toArray()
    weight = len(y) / (2 * np.where(y == 1, y.sum(), (1 - y).sum())) if balanced else np.ones(len(y))
    residual = weight * (1 / (1 + np.exp(-(x @ w + model.intercept))) - y)
    gradient = 2.0 * x.T @ residual + w
    assert np.abs(gradient).max() < 0.05 and abs(residual.sum()) < 0.05
    train.unpersist()


def test_trees_repeat_with_their_seed(tape):
    rows, features = modeling.prepare_data(*tape)
    rows = rows.cache()
    train, test = rows.where("role='train'"), rows.where("role='test'")
    for fit in (
        lambda: modeling.train_random_forest(train, features, trees=5),
        lambda: modeling.train_boosted_trees(train, features, rounds=4),
    ):
        a, b = (modeling.evaluate_model(fit(), test).first() for _ in range(2))
        assert a == b and a.accuracy > 0.7
    rows.unpersist()


def test_compare_save_and_load(tape, tmp_path):
    path = str(tmp_path / "model")
    trainers = {
        "logistic_regression": modeling.train_logistic_regression,
        "forest": lambda t, f: modeling.train_random_forest(t, f, trees=5),
    }
    out = modeling.compare_models(*tape, model_path=path, trainers=trainers)
    assert out["results"].count() == 2 and out["warning"] is None
    model, metadata = models.load_model(path)
    assert metadata["model_name"] == out["best_model"] and metadata["features"] == out["features"]
    test = out["prepared"].where("role='test'")
    best = modeling.evaluate_model(model, test).first()
    assert best.f1 == pytest.approx(metadata["metrics"]["f1"])


def test_cross_validation(tape):
    out = modeling.cross_validate(*tape)
    folds = out["folds"].orderBy("fold").collect()
    assert len(folds) == 5 and all(f.accuracy > f.baseline for f in folds[1:])
    assert [f.train_rows for f in folds] == sorted(f.train_rows for f in folds)
    importance = [r.feature for r in out["importance"].collect()]
    assert len(importance) == 7 and set(importance[:2]) & {"sentiment_score_raw", "sentiment_ma2"}
    row = out["summary"].first()
    assert row.improvement == pytest.approx(row.avg_accuracy - row.avg_baseline)
    assert modeling.cross_validate(*tape, least_rows=10**6) is None
    by_fold = modeling.cross_validate(*tape, fit_scope="train")["folds"].orderBy("fold").collect()
    assert [f.train_rows for f in by_fold] == [f.train_rows for f in folds]
    assert all(f.accuracy > f.baseline for f in by_fold[1:])


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "prediction int, target int")
    row = modeling.evaluate_predictions(df).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 0.5)
    assert row.confusion_matrix == [[1, 0], [1, 0]]
    report = {r["class"]: r for r in modeling.class_report(df).collect()}
    assert report[0].precision == 0.5 and report[1].support == 1 and report[1].f1 == 0


@pytest.mark.parametrize("job", [lambda b, s: modeling.prepare_data(b, s)[0], lambda b, s: modeling.cross_validate(b, s)["folds"]])
def test_texts_are_scored_once(spark, tape, job):
    bars, scores = tape
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(score):
        seen.add(1)
        return score

    scored = scores.select("ticker", "date", "headline_count", counted("sentiment_score").alias("_score"))
    daily = scored.groupBy("ticker", "date").agg(F.avg("_score").alias("sentiment_score"), F.max("headline_count").alias("headline_count"))
    job(bars, daily).collect()
    assert seen.value == scores.count()
