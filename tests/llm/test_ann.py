import numpy as np
import pytest
from pyspark.sql import functions as F

from newstape.llm import ann

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = []
    valid = {}
    for key, v in rows:
        if key is not None and v and None not in v and np.isfinite(v).all() and any(v):
            valid[(key, tuple(v))] = np.array(v, float)
    for (q, _), x in valid.items():
        if q not in queries:
            continue
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for (i, _), y in valid.items() if i != q and len(y) == len(x))
        out.extend((q, n + 1, i, d) for n, (d, i) in enumerate(near[:k]))
    return sorted(out)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    exact = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = [tuple(r) for r in ann.op4_nearest(spark, SF).collect()]
    wanted = {(q, i) for q, _, i, _ in exact}
    assert len(got) == len(exact)
    assert len(wanted & {(q, i) for q, _, i, _ in got}) >= 0.9 * len(wanted)


def test_copies_ties_and_rows_that_take_no_part(spark):
    draw = np.random.default_rng(1)
    rows = [(int(i), draw.normal(size=8).round(1).tolist()) for i in range(60)]
    rows += [(int(i), [1.0] * 8) for i in range(100, 240)]  # far more copies than neighbours asked for
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [None] * 8), (None, [1.0] * 8)]
    rows += [(305, [-0.0, 1.0]), (306, [0.0, 1.0]), rows[0], (400, [float("inf")] * 8)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, bucket string").repartition(5)
    got = sorted(tuple(r) for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 5).collect())
    assert got == [(q, n, i, pytest.approx(d, abs=1e-12)) for q, n, i, d in brute(rows, set(range(0, 400, 20)), 5)]


def test_groups_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_VECTORS", 16)
    draw = np.random.default_rng(2)
    rows = [(int(i), (draw.normal(size=4) * 0.01 + 1).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, 3).collect()
    wanted = brute(rows, set(range(0, 300, 50)), 3)
    assert len(got) == len(wanted)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in wanted}) >= 0.9 * len(wanted)


def test_no_rows_and_fewer_than_asked_for(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(table, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).collect() == []


def test_probes_go_from_likely_to_unlikely():
    hashing = ann.Hashing(1.0, 20)
    query = np.random.default_rng(3).normal(size=(1, 16))
    own = hashing.bucket(np.floor(hashing.cells(query, 0)), 16)
    assert hashing.probe(query, 0)[0, 0] == own[0]
    assert len(set(hashing.probe(query, 0)[0].tolist())) == 20
