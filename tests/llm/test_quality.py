import zlib

import numpy as np
import pyarrow as pa
import pytest

from newstape.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = quality.op3_quality(spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_fold_is_the_crc_of_the_id(spark):
    found = spark.range(200).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in found)


def test_features_of_odd_texts():
    texts = ["", "a", "Ünïcödé ß", "x" * 300_000, "w " * 50_000, "\n\n", "AAA!! ###"]
    found = quality.features_of(pa.array(texts, pa.large_string()))
    assert found.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(found).all()
    assert not found[0].any()
    alone = np.concatenate([quality.features_of(pa.array([t], pa.large_string())) for t in texts])
    assert found == pytest.approx(alone)


def test_missing_labels_and_tables(spark, frame):
    docs = frame([(1, "some words"), (2, None), (None, ""), (2, "again")])
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (9, 0, 1), (2, 5, 0)], "doc_id long, quality int, toxic int")
    ranking = quality.learn(docs, labels)
    assert [r.score for r in quality.score_documents(docs, ranking).collect()] == [0.5] * 4
    assert quality.accepted(docs, ranking).count() == 4
    empty = quality.learn(docs.limit(0), labels.limit(0))
    assert quality.score_documents(docs.limit(0), empty).count() == 0


def test_accepted_keeps_rows_as_they_are(spark, frame):
    clean = "plain words in a quiet sentence of some length. " * 5
    rows = [(i, clean + str(i)) for i in range(0, 60)] + [(i, "BUY!! NOW!! ### $$$ " * 9) for i in range(60, 120)]
    docs = frame(rows + [rows[0]])
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, quality int")
    kept = quality.accepted(docs, quality.learn(docs, labels))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(60), 0])


def test_fit_rows_bound_the_sample(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert 300 < quality.bounded_sample(labels, 500).count() < 700


def test_threshold_covers_all_training_labels(spark, frame):
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(1500):
        good = int(draw.random() < 0.8)
        words = ["plain", "words", "of", "text", "!!!", "###", "BUY"]
        weights = [6, 5, 5, 4, 1, 1, 1] if good else [2, 2, 2, 2, 3, 3, 3]
        rows.append((i, " ".join(draw.choice(words, draw.integers(5, 60), p=np.array(weights) / sum(weights)))))
        labels.append((i, good))
    ranking = quality.learn(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int"), fit_rows=200)
    training = [i for i, _ in labels if zlib.crc32(str(i).encode()) % quality.FOLDS != quality.HELD_OUT_FOLD]
    texts = pa.array([rows[i][1] for i in training], pa.large_string())
    strength = quality.features_of(texts) @ np.array(ranking.weights)
    bad = np.mean([labels[i][1] == 0 for i in training])
    assert ranking.threshold == pytest.approx(np.quantile(strength, bad), rel=1e-9)
    assert ranking.scale == pytest.approx(strength.std(ddof=1) / 4, rel=1e-9)


@pytest.mark.parametrize("cells", [2, 4096])
def test_quantiles_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(quality, "CELLS", cells)
    draw = np.random.default_rng(2)
    for values in ([3.0], [1.0, 2.0], [0.5] * 9, [*draw.normal(size=40).round(1), -1e9, 1e-9]):
        table = spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(1)
        for p in (0.0, 0.37, 0.5, 1.0):
            assert quality.quantile(table, "v", p) == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)
    assert quality.quantile(table.limit(0), "v", 0.5) is None
