"""Quality scores learned from preference pairs (Bradley-Terry).

Of a pair of labelled documents the one with label 1 is preferred. The model gives every document a strength, linear
in its features, and the chance that one document beats another is the logistic function of the difference of their
strengths: logistic regression without intercept on feature differences. A quantile of the strengths, the share of
label 0 among the training labels, is the threshold between the classes.

Features come from a document's whole text and from nothing else: shares of byte classes, repetition, lengths of
words and lines. They are one pass over the text. The fit uses a sample of bounded size; the share, its quantile and
the scale of the strengths come from all training labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import slices, strings_of, words_of
from newstape.session import cut_lineage

#: Labelled training documents that a fit uses at most, about; they are chosen by a hash of the id.
FIT_ROWS = 20_000
#: Opponents of each document of the rarer label, in expectation (pairs grow with the sample, not with its square).
OPPONENTS = 16
FOLDS, HELD_OUT_FOLD = 3, 1
#: Cells of a grid that a quantile is searched with.
CELLS = 4096

FEATURES = (
    "upper", "lower", "digit", "space", "newline", "mark", "symbol", "pipe", "beyond_ascii", "mark_run", "symbol_run",
    "upper_run", "word_bytes", "word_spread", "distinct_words", "repeated_words", "lone_bytes", "long_words",
    "line_bytes", "length", "top_word",
)


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 mark, 7 symbol, 8 pipe, 9 beyond."""
    table = np.zeros(256, np.uint8)
    for number, members in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:!?'\"()-",
         b"#$%&*+/<=>@[\\]^_`{}~", b"|"), 1,
    ):
        table[np.frombuffer(members, np.uint8)] = number
    table[128:] = 9
    return table


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zero for an empty one."""
    n = len(texts)
    texts = pa.concat_arrays([texts])
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    classes, text = _byte_classes()[data], np.repeat(np.arange(n, dtype=np.int32), sizes)
    counts = np.bincount(text.astype(np.int64) * 10 + classes, minlength=n * 10).reshape(n, 10).astype(float)
    same = (classes[1:] == classes[:-1]) & (text[1:] == text[:-1])
    runs = np.stack([np.bincount(text[1:][same & (classes[1:] == c)], minlength=n) for c in (6, 7, 1)], 1)
    size = np.maximum(sizes, 1).astype(float)[:, None]
    codes, words, distinct = words_of(texts)
    owner = np.repeat(np.arange(n), words)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(float)[codes]
    many = np.maximum(words, 1).astype(float)
    mean = np.bincount(owner, weights=length, minlength=n) / many
    spread = np.sqrt(np.maximum(np.bincount(owner, weights=length**2, minlength=n) / many - mean**2, 0))
    pair, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
    of = pair // max(len(distinct), 1)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    lines = counts[:, 5] + 1
    columns = [
        counts[:, 1:10] / size,
        runs / size,
        mean[:, None] / 10,
        spread[:, None] / 10,
        (np.bincount(of, minlength=n) / many)[:, None],
        (np.bincount(owner[1:][again], minlength=n) / many)[:, None],
        (np.bincount(owner[length <= 1], minlength=n) / many)[:, None],
        (np.bincount(owner[length > 20], minlength=n) / many)[:, None],
        (np.log1p(sizes / lines) / 10)[:, None],
        (np.log1p(sizes) / 10)[:, None],
        (top / many)[:, None],
    ]
    return np.where(sizes[:, None] > 0, np.concatenate(columns, 1), 0.0)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            found = features_of(strings_of(part.column(1)))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "features"])


def with_features(documents: DataFrame) -> DataFrame:
    """(doc_id, features) of each row; null texts count as empty."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_feature_batches, "doc_id long, features array<double>")


def strength_of(features, weights: list[float]) -> F.Column:
    products = F.zip_with(features, F.array(*map(F.lit, weights)), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


class Ranking(NamedTuple):
    """Strength = weights . features; ``threshold`` and ``scale`` put it on a scale from 0 to 1."""

    weights: list[float]
    threshold: float
    scale: float

    def score(self, features) -> F.Column:
        strength = strength_of(features, self.weights)
        return 1 / (1 + F.exp((F.lit(self.threshold) - strength) / F.lit(self.scale)))


def preference_pairs(labelled: DataFrame, opponents: int = OPPONENTS) -> DataFrame:
    """Feature differences (difference, label) of pairs of documents with label 1 and label 0.

    Both labels are dealt into slots by a hash of the id, once for each round, and meet in their slot. Half of the
    pairs, by hash, are given from the loser's side, so that both outcomes occur.
    """
    counts = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    slots = max(good, bad, 1)
    dealt = labelled.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(opponents))))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("doc_id", "round"), F.lit(slots)))
    side = {
        q: dealt.where(F.col("quality") == q).select("round", "slot", F.col("features").alias(f"f{q}"), F.col("doc_id").alias(f"d{q}"))
        for q in (0, 1)
    }
    met = side[1].join(side[0], ["round", "slot"])
    turned = F.xxhash64("d0", "d1").bitwiseAND(F.lit(1)) == 1
    sign = F.when(turned, -1.0).otherwise(1.0)
    difference = F.zip_with("f1", "f0", lambda a, b: (a - b) * sign)
    return met.select(difference.alias("difference"), F.when(turned, 0.0).otherwise(1.0).alias("label"))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of all labelled documents.

    Labels other than 0 and 1, and rows without an id, are left out; of several labels of a document the largest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def bounded_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality) of about ``fit_rows`` labelled documents at most, chosen by a hash of the id."""
    known = known_labels(labels)
    share = min(1.0, fit_rows / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(sample: DataFrame, opponents: int = OPPONENTS) -> list[float] | None:
    """Weights learned from (doc_id, features, quality) with labels 0 and 1, a sample of bounded size.

    Without documents of both labels there is nothing to prefer, and no weights.
    """
    if sample.select("quality").distinct().count() < 2:
        return None
    pairs = cut_lineage(preference_pairs(sample, opponents)).select(array_to_vector("difference").alias("features"), "label")
    if not pairs.take(1):
        return None
    model = LogisticRegression(fitIntercept=False, standardization=True, regParam=1e-4, maxIter=60).fit(pairs)
    return [float(w) for w in model.coefficients]


def quantile(values: DataFrame, column: str, p: float) -> float | None:
    """The exact quantile, interpolated, of finite values; None without any.

    The cell of a grid that holds the wanted rank becomes the next grid, until the rank is an edge of its cell: ``CELLS``
    rows reach the driver each time, and no task holds or sorts all values.
    """
    n, lo, hi = values.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return None
    at = p * (n - 1)
    rank = math.floor(at)
    part, before = at - rank, 0
    # The next value up, if it is wanted, always lies between lo and hi too.
    while lo < hi:
        spot = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(hi - lo) * CELLS), F.lit(CELLS - 1))
        inside = values.where(F.col(column).between(lo, hi)).groupBy(spot.alias("spot"))
        rows = sorted(inside.agg(F.count("*"), F.min(column), F.max(column)).collect())
        for i, (_, count, lo, hi) in enumerate(rows):
            if rank < before + count:
                break
            before += count
        if rank == before + count - 1 and i + 1 < len(rows):
            return hi + (rows[i + 1][2] - hi) * part
        if rank == before + count - 1:
            return hi
    return lo


def held_out(doc_id: str = "doc_id"):
    """Whether learning leaves the document out; rows without an id are not labelled anyway."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, opponents: int = OPPONENTS) -> Ranking:
    """A ranking from the labelled documents that are not held out: weights from a bounded sample, the rest from all.

    The sample's ids go to the documents (a broadcast of about ``fit_rows`` rows at most), and strengths are computed
    before they meet their labels, so no text is shuffled. Without weights every document scores one half.
    """
    known = cut_lineage(known_labels(labels.where(~held_out())))
    sample = F.broadcast(cut_lineage(bounded_sample(known, fit_rows)))
    texts = documents.select("doc_id", "text").join(sample.select("doc_id"), "doc_id", "left_semi")
    weights = fit(cut_lineage(with_features(texts).join(sample, "doc_id")), opponents)
    if weights is None:
        return Ranking([0.0] * len(FEATURES), 0.0, 1.0)
    training = with_features(documents.where(F.col("doc_id").isNotNull() & ~held_out()))
    ranked = training.select("doc_id", strength_of("features", weights).alias("s")).join(known, "doc_id").select("s", "quality")
    ranked = cut_lineage(ranked)
    losers, spread = ranked.agg(F.avg((F.col("quality") == 0).cast("double")), F.stddev_samp("s")).first()
    return Ranking(weights, quantile(ranked, "s", losers), max(spread or 0.0, 1e-9) / 4)


def score_documents(documents: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score, predicted) of each row; the whole text counts, an empty or null one has all features zero."""
    scored = with_features(documents).select("doc_id", ranking.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(documents: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``documents`` that score at least 0.5, with all their columns; repeated rows stay."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                strength = features_of(strings_of(part.column("text"))) @ np.array(ranking.weights)
                kept = pa.array(1 / (1 + np.exp((ranking.threshold - strength) / ranking.scale)) >= 0.5)
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in part.columns], names)

    return documents.mapInArrow(run, documents.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranking = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(documents, ranking).select("doc_id", held_out().alias("held_out"), "score", "predicted")
