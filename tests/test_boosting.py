"""Second-order boosting against a plain fit of the same trees, one row after the other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newstape.operators import boosting, modeling
from newstape.sources import models

KINDS = "a double, b double, c double, target int"


def rows(n=400, seed=3, holes=True):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), float(draw.randrange(6)), draw.uniform(-1, 1)
        y = int(a + (b > 2) * c * 2 + draw.gauss(0, 0.4) > 0)
        out.append((None if holes and i % 9 == 0 else a, b, float("nan") if holes and i % 14 == 0 else c, y))
    return out


def grow(x, g, h, depth, cuts, rate, penalty, least_bend):
    """A tree as nested tuples (feature, cut, missing left, left, right) or a leaf's weight."""
    G, H = g.sum(), h.sum()
    best, found = 1e-6, None
    for f in range(x.shape[1]) if depth else ():
        gone = np.isnan(x[:, f])
        for cut in cuts[f]:
            for side in (False, True):
                left = np.where(gone, side, x[:, f] < cut)
                if not 0 < left.sum() < len(left) or min(h[left].sum(), h[~left].sum()) < least_bend:
                    continue
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, ~left)) - G**2 / (H + penalty)
                if gain > best + 1e-9:
                    best, found = gain, (f, cut, side, left)
    if not found:
        return -rate * G / (H + penalty)
    f, cut, side, left = found
    return f, cut, side, *[grow(x[s], g[s], h[s], depth - 1, cuts, rate, penalty, least_bend) for s in (left, ~left)]


def walk(tree, row):
    while isinstance(tree, tuple):
        f, cut, side, left, right = tree
        tree = left if (side if math.isnan(row[f]) else row[f] < cut) else right
    return tree


@pytest.mark.parametrize("depth,rounds,penalty", [(1, 5, 1.0), (3, 13, 0.5)])
def test_trees_equal_a_plain_fit(spark, depth, rounds, penalty):
    """More rounds than margins are kept for, missing values in two columns, a column of few values."""
    data = rows()
    frame = spark.createDataFrame(data, KINDS).repartition(5)
    cuts = {"a": [-1.5, -0.5, 0.0, 0.4, 1.1], "b": [1, 2, 3, 4, 5], "c": [-0.6, -0.2, 0.2, 0.6]}
    model = boosting.fit_boosted_trees(frame, list("abc"), rounds=rounds, max_depth=depth, penalty=penalty, cuts=cuts)
    x = np.array([[np.nan if v is None else v for v in r[:3]] for r in data], float)
    y = np.array([r[3] for r in data])
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for t in range(rounds):
        assert model.losses[t] == pytest.approx((np.logaddexp(0, z) - y * z).mean())
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, p - y, p * (1 - p), depth, list(cuts.values()), 0.1, penalty, 1.0)
        z = z + np.array([walk(tree, r) for r in x])
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    got = model.predict(spark.createDataFrame([(*r, i) for i, r in enumerate(data)], KINDS + ", i int")).orderBy("i").toPandas()
    assert np.allclose(got.probability, 1 / (1 + np.exp(-z)), atol=1e-9) and len(got) == len(data)


def test_leaves_follow_from_the_sums_of_their_rows(spark):
    model = boosting.fit_boosted_trees(spark.createDataFrame(rows(), KINDS), list("abc"), rounds=6)
    nodes = model.nodes(spark).toPandas()
    leaves = nodes[nodes.feature.isna()]
    assert np.allclose(leaves.value, -0.1 * leaves.g / (leaves.h + 1)) and (leaves.h >= 1).all()
    assert (leaves.groupby("tree").rows.sum() == 400).all()
    share = {r.feature: r.importance for r in model.importance(spark).collect()}
    assert sum(share.values()) == pytest.approx(1) and min(share.values()) >= 0


def test_quantiles_as_cuts(spark):
    frame = spark.createDataFrame([(float(i), 1.0, None if i else 2.0, i % 2) for i in range(100)], KINDS)
    a, b, c = boosting.quantile_cuts(frame, list("abc"))
    assert list(a) == [float(i) for i in range(1, 100)] and len(b) == len(c) == 0


def test_odd_tables(spark):
    """No rows are an error; rows without a label are left out; one class, constant and empty columns give a constant."""
    frame = spark.createDataFrame([(1.0, None, 3.0, 1), (1.0, None, 3.0, 1), (2.0, 5.0, None, None)], KINDS)
    model = boosting.fit_boosted_trees(frame, list("abc"), rounds=2)
    assert all(n[2] is None for n in model.node_rows()) and [n[8] for n in model.node_rows()] == [2, 2]
    assert [r.prediction for r in model.predict(frame).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        boosting.fit_boosted_trees(frame.where("target = 0"), list("abc"))


def test_stored_and_read_back(spark, tmp_path):
    frame = spark.createDataFrame(rows(), KINDS)
    model = modeling.train_boosted_trees(frame, list("abc"), rounds=12)
    path = models.save_model(model, str(tmp_path / "m"), {"by": "boosting"})
    again, metadata = models.load_model(path)
    assert metadata == {"by": "boosting"} and again.node_rows() == model.node_rows()
    both = model.predict(frame).select(F.sum("probability")).first()[0], again.predict(frame).select(F.sum("probability")).first()[0]
    assert both[0] == pytest.approx(both[1]) and again.losses == model.losses
