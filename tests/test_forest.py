import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstape.operators import forest, modeling
from newstape.sources import models

KINDS = "a double, b double, c double, target int"


def noisy(n=600, seed=1):
    draw = random.Random(seed)
    return [(draw.gauss(0, 1) ** 5, draw.uniform(0, 1), float(draw.randrange(4)), draw.randrange(2)) for _ in range(n)]


def total(spark, model, frame):
    return model.predict(frame).agg(F.sum("probability"), F.avg((F.col("prediction") == F.col("target")).cast("int"))).first()


@pytest.mark.parametrize("group_rows", [10**6, 40])
def test_a_tree_that_sees_all_rows_makes_no_error(spark, group_rows):
    """Random labels: only unlimited depth and exact splits fit them; with 40 rows a group the upper nodes are split by passes."""
    frame = spark.createDataFrame(noisy(), KINDS).repartition(3)
    model = forest.fit_forest(frame, list("abc"), trees=2, bootstrap=False, group_rows=group_rows)
    assert total(spark, model, frame)[1] == 1.0
    leaves = [t[4][t[0] < 0] for t in model.trees]
    assert all(set(np.unique(v)) <= {0.0, 1.0} for v in leaves)


def test_best_cut_equals_all_cuts():
    draw = np.random.default_rng(3)
    for _ in range(50):
        x, y, w = draw.integers(0, 6, 12).astype(float), draw.integers(0, 2, 12), draw.integers(1, 4, 12)
        scores = {}
        for c in sorted(set(x))[:-1]:
            sides = [(w[s] * y[s]).sum() * (w[s] * (1 - y[s])).sum() / w[s].sum() for s in (x <= c, x > c)]
            scores[c] = sum(sides)
        found = forest.best_cut(x, y, w)
        assert (found is None) == (not scores)
        if scores:
            assert found[0] == pytest.approx(min(scores.values())) and (x <= found[1]).sum() in {
                (x <= c).sum() for c, s in scores.items() if s == pytest.approx(min(scores.values()))
            }
    assert forest.best_cut(np.array([1.0, np.nextafter(1.0, 2)]), np.array([0, 1]), np.array([1, 1]))[1] == 1.0


def test_draws_are_poisson():
    key = np.random.default_rng(0).integers(-(2**62), 2**62, 40_000)
    for mean in (1, 5, 100):
        got = forest.draws(key, np.full(len(key), mean), 3, 42)
        assert got.mean() == pytest.approx(mean, rel=0.03) and got.var() == pytest.approx(mean, rel=0.06) and got.min() >= 0
    a, b = (forest.draws(key, np.ones(len(key)), t, 42) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and (a == forest.draws(key, np.ones(len(key)), 0, 42)).all()


@pytest.mark.parametrize("group_rows", [10**6, 60])
def test_forest_learns_and_repeats(spark, group_rows):
    draw = random.Random(4)
    rows = []
    for _ in range(700):
        a, b, c = draw.gauss(0, 1), draw.gauss(0, 1), draw.uniform(-1, 1)
        rows.append((a, b, c, int(a * b > 0)))
    rows += [rows[0]] * 300  # a hot copy is one merged row
    frame = spark.createDataFrame(rows, KINDS)
    one = forest.fit_forest(frame.repartition(5), list("abc"), trees=25, group_rows=group_rows)
    two = forest.fit_forest(frame.repartition(2), list("abc"), trees=25, group_rows=group_rows)
    assert all((x == y).all() for s, t in zip(one.trees, two.trees) for x, y in zip(s, t))
    fresh = [(a, b, 0.0, int(a * b > 0)) for a, b in ((draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(500))]
    assert total(spark, one, spark.createDataFrame(fresh, KINDS))[1] > 0.9


def test_odd_tables(spark):
    """Contradicting copies share a leaf, one class is a constant, missing values are left out and go right."""
    frame = spark.createDataFrame([(1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, 0), (2.0, 1.0, 1.0, 1), (None, 1.0, 1.0, 0), (float("nan"), 1.0, 1.0, 0)], KINDS)
    model = forest.fit_forest(frame, list("abc"), trees=1, bootstrap=False, tried=3)
    assert [r.probability for r in model.predict(frame).collect()] == [0.5, 0.5, 1.0, 1.0, 1.0]
    one = forest.fit_forest(frame.where("target = 1"), list("abc"), trees=3, group_rows=1)
    assert {r.prediction for r in one.predict(frame).collect()} == {1}
    with pytest.raises(ValueError):
        forest.fit_forest(frame.limit(0), list("abc"))


def test_stored_and_read_back(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame(noisy(200), KINDS)
    model = modeling.train_random_forest(frame, list("abc"), trees=7)
    again, _ = models.load_model(models.save_model(model, str(tmp_path / "m")))
    assert all((x == y).all() for s, t in zip(model.trees, again.trees, strict=True) for x, y in zip(s, t))
    whole = total(spark, model, frame)
    monkeypatch.setattr(forest, "NODES_HELD", 100)  # several functions instead of one
    assert tuple(total(spark, again, frame)) == pytest.approx(tuple(whole))
