"""Toxic spans from a linear-chain conditional random field, document scores from its marginals.

Every word of a text is tagged 0 or 1. A word's emission is a sum of learned weights of its features (the word, its
beginnings and endings, without case and outer punctuation), hashed into ``SLOTS`` weights; two neighbouring tags
add a transition weight. Forward-backward gives each word's marginal chance of tag 1 from the whole text. The sum of
the marginals, the expected number of toxic words, makes a document's score (logistic, beside its number of words); its
spans are the stretches of words whose marginals reach one half.

Documents are labelled, words are not: a word of a document with label 1 counts as labelled 1 if one of its features is
significantly tied to that label (likelihood ratio over documents, corrected for the number of features; copies count
once), every other word as labelled 0. Learning uses a sample of bounded size; its shards take steps on their own and
the weights are averaged after each round.

The chain of a batch is one product of 2 x 2 matrices, in which a text's first word forgets what was before. It is cut
into rows of ``ROW`` words; all rows go forward and backward together in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import give_back, hashes_of, mix, slices, strings_of, words_of
from newstape.session import cut_lineage

#: Labelled training documents of each label that a fit uses at most, about; they are chosen by a hash of the id.
FIT_ROWS = {0: 8_000, 1: 4_000}
FOLDS, HELD_OUT_FOLD = 3, 1
#: A document is called toxic from this score on, a word belongs to a span from this marginal on.
TOXIC, SPAN = 0.7, 0.5
SLOTS = 1 << 18
#: Added to the expected number of toxic words before its logarithm is taken.
LEAST_EXPECTED = 0.05
#: Bytes of the beginnings and endings of words that are features.
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 8), (3, 4, 5)
#: A labelling feature is at least so many times as common in documents with label 1.
TIMES = 10
#: Words of a gradient step, and how many steps an epoch has at least.
SHARDS, ROUNDS, EPOCHS, STEP_WORDS, LEAST_STEPS = 8, 3, 3, 100_000, 6
RATE, DECAY = 0.5, 1e-6
ROW = 256
BATCH_BYTES = 1 << 20
OUTER = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”‘’…¿¡"

_word = regex.compile("[^\x20\x09-\x0d]+")


class Tagger(NamedTuple):
    """``weights``: of the hashed features and, last, of every word; ``transitions[a, b]``: from tag a to tag b."""

    weights: np.ndarray
    transitions: np.ndarray


class Model(NamedTuple):
    """A tagger, and the logistic weights of a document's evidence."""

    tagger: Tagger
    weights: list[float]
    intercept: float


def feature_slots(words: pa.Array) -> np.ndarray:
    """The 64-bit features of each distinct word (binary, lower case), one row a word; 0 stands for none."""
    cores = pc.utf8_trim(words.cast(pa.large_string()), characters=OUTER).cast(pa.large_binary())
    sizes = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(cores.to_pylist()) + b"\0" * 8, np.uint8)
    begin = np.cumsum(sizes) - sizes
    columns = [np.where(sizes > 0, mix(hashes_of(cores, 7)), 0)]
    for k in BEGINNINGS:
        columns.append(_bytes_at(data, begin, sizes, k, k))
    for k in ENDINGS:
        columns.append(_bytes_at(data, begin + sizes - k, sizes, k, 100 + k))
    return np.stack(columns, 1).astype(np.uint64)


def _bytes_at(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, k: int, kind: int) -> np.ndarray:
    there = sizes >= k
    value = np.zeros(len(sizes), np.uint64)
    for j in range(k):
        value = value << np.uint64(8) | data[np.where(there, begin + j, 0)].astype(np.uint64)
    return np.where(there, mix(value ^ mix(np.uint64([kind]))), 0)


def slots_of(features: np.ndarray) -> np.ndarray:
    """Places of features in ``weights``; absent ones share the place after the last, whose weight stays 0."""
    return np.where(features == 0, np.uint64(SLOTS + 1), features % np.uint64(SLOTS)).astype(np.int64)


def emissions_of(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.append(weights, 0.0)[slots].sum(1) + weights[SLOTS], -30, 30)


def chain(emissions: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tag 1 of all words, and the forward and backward messages (2 x words, each column sums to 1).

    ``offsets`` are the bounds of the texts; the word before a text counts as tagged 0.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((2, 0)), np.zeros((2, 0))
    rows = -(-n // ROW)
    m = np.zeros((2, 2, rows * ROW))
    m[0, 0, n:] = m[1, 1, n:] = 1  # padding changes nothing
    t, e = np.exp(transitions), np.exp(emissions)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    for a in (0, 1):
        m[a, 0, :n] = np.where(first, t[0, 0], t[a, 0])
        m[a, 1, :n] = np.where(first, t[0, 1], t[a, 1]) * e
    m[:, :, :n] /= m[:, :, :n].sum((0, 1))
    m = m.reshape(2, 2, rows, ROW).transpose(0, 1, 3, 2).copy()  # [from, to, place in the row, row]

    whole = np.zeros((2, 2, rows))
    whole[0, 0] = whole[1, 1] = 1
    for j in range(ROW):
        w, x = whole, m[:, :, j]
        whole = np.stack([w[:, 0] * x[0, b] + w[:, 1] * x[1, b] for b in (0, 1)], 1)
        whole /= whole.sum((0, 1))
    ahead, behind = np.zeros((2, rows)), np.zeros((2, rows))
    state, back = np.array([1.0, 0.0]), np.array([0.5, 0.5])
    for r in range(rows):
        ahead[:, r] = state
        state = state @ whole[:, :, r]
        state /= state.sum()
    for r in range(rows - 1, -1, -1):
        behind[:, r] = back
        back = whole[:, :, r] @ back
        back /= back.sum()

    alpha, beta = np.zeros((2, ROW, rows)), np.zeros((2, ROW, rows))
    for j in range(ROW):
        a0, a1 = ahead
        step = m[:, :, j]
        ahead = np.stack([a0 * step[0, 0] + a1 * step[1, 0], a0 * step[0, 1] + a1 * step[1, 1]])
        ahead /= ahead.sum(0)
        alpha[:, j] = ahead
    for j in range(ROW - 1, -1, -1):
        beta[:, j] = behind
        b0, b1 = behind
        step = m[:, :, j]
        behind = np.stack([step[0, 0] * b0 + step[0, 1] * b1, step[1, 0] * b0 + step[1, 1] * b1])
        behind /= behind.sum(0)
    alpha = alpha.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    beta = beta.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    both = alpha * beta
    return both[1] / both.sum(0), alpha, beta


def expected_transitions(emissions, offsets, transitions, alpha, beta) -> np.ndarray:
    """Expected number of words whose tag and the one before are (a, b); a text's first word follows a 0."""
    if not len(emissions):
        return np.zeros((2, 2))
    before = np.concatenate([[[1.0], [0.0]], alpha[:, :-1]], 1)
    before[:, offsets[:-1][np.diff(offsets) > 0]] = [[1.0], [0.0]]
    after = beta * np.stack([np.ones_like(emissions), np.exp(emissions)])
    joint = before[:, None] * np.exp(transitions)[:, :, None] * after[None]
    return (joint / joint.sum((0, 1))).sum(2)


def gradient(slots, codes, offsets, tags, tagger: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of the tags: observed minus expected features and transitions."""
    types = emissions_of(slots, tagger.weights)
    emissions = types[codes]
    marginals, alpha, beta = chain(emissions, offsets, tagger.transitions)
    rest = np.bincount(codes, weights=tags - marginals, minlength=len(slots))
    weights = np.bincount(slots.reshape(-1), weights=np.repeat(rest, slots.shape[1]), minlength=SLOTS + 2)[: SLOTS + 1]
    weights[SLOTS] = rest.sum()
    previous = np.concatenate([[0], tags[:-1]]).astype(np.int64)
    previous[offsets[:-1][np.diff(offsets) > 0]] = 0
    observed = np.bincount(previous * 2 + tags.astype(np.int64), minlength=4).reshape(2, 2)
    return weights, observed - expected_transitions(emissions, offsets, tagger.transitions, alpha, beta)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all labelled documents.

    Labels other than 0 and 1, and rows without an id, are left out; of several labels of a document the largest counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def held_out(doc_id: str = "doc_id"):
    """Whether learning leaves the document out; rows without an id are not labelled anyway."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def bounded_sample(known: DataFrame, fit_rows: dict[int, int]) -> DataFrame:
    """(doc_id, toxic) of about ``fit_rows`` documents of each label at most, chosen by a hash of the id."""
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("tags")), F.lit(1 << 20))
    chosen = F.lit(False)
    for label, rows in fit_rows.items():
        share = min(1.0, rows / max(counts.get(label, 0), 1))
        chosen = chosen | ((F.col("toxic") == label) & (spot < int(share * (1 << 20))))
    return known.where(chosen)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hash of the three-word shingles of each text: copies, and most near copies, share it."""
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            codes, counts, distinct = words_of(strings_of(part.column("text")))
            hashes = hashes_of(distinct)[codes] if len(distinct) else np.zeros(0, np.uint64)
            ends = np.cumsum(counts)
            found = []
            for lo, hi in zip((ends - counts).tolist(), ends.tolist()):
                own = hashes[lo:hi]
                if len(own) > 2:
                    own = mix(own[:-2] ^ mix(own[1:-1] ^ mix(own[2:])))
                found.append(int(own.min(initial=np.uint64(1 << 63))) >> 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], [*part.schema.names, "sketch"])


def sample_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(shard, doc_id, toxic, text) of the sample, copies once."""
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    sketched = texts.select("doc_id", "toxic", "text").mapInArrow(_sketches, "doc_id long, toxic int, text string, sketch long")
    one = sketched.groupBy("sketch").agg(F.min_by(F.struct("doc_id", "toxic", "text"), "doc_id").alias("d"))
    return one.select(F.pmod(F.xxhash64("d.doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "d.*")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): numbers of documents that hold a feature, of the texts of each slice."""
    for batch in batches:
        for part in slices(batch, "text", 8 * BATCH_BYTES):
            codes, counts, distinct = words_of(strings_of(part.column("text")))
            features, place = np.unique(feature_slots(distinct), return_inverse=True)
            place = place.reshape(len(distinct), -1)
            label = part.column("toxic").to_numpy(zero_copy_only=False)
            ends, totals = np.cumsum(counts), np.zeros((2, len(features)), np.int64)
            for lo, hi, y in zip((ends - counts).tolist(), ends.tolist(), label.tolist()):
                totals[y, np.unique(place[np.unique(codes[lo:hi])])] += 1
            real = features > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(features[real].view(np.int64)), pa.array(totals[1][real]), pa.array(totals[0][real])],
                ["feature", "toxic", "clean"],
            )


def labelling_features(sample: DataFrame) -> np.ndarray:
    """Sorted features that mark words as toxic: significantly more documents of label 1 hold them."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not b:
        return np.zeros(0, np.uint64)
    found = sample.select("toxic", "text").mapInArrow(_feature_counts, "feature long, toxic long, clean long")
    found = cut_lineage(found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    tested = max(found.count(), 2)
    x, y = F.col("toxic"), F.col("clean")
    rate = (x + y) / F.lit(a + b)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(x, rate * a) + part(y, rate * b) + part(F.lit(a) - x, (1 - rate) * a) + part(F.lit(b) - y, (1 - rate) * b))
    tied = (x / F.lit(a) >= TIMES * y / F.lit(b)) & (ratio >= 2 * math.log(tested))
    return np.sort(np.array([r[0] for r in found.where(tied).select("feature").collect()], np.int64).view(np.uint64))


def _train(marks: np.ndarray, tagger: Tagger):
    """Steps of one shard: gradients of some texts at a time, each weight at a rate of its own (AdaGrad)."""

    def run(table: pa.Table) -> pa.Table:
        texts, toxic = strings_of(table.column("text")), table.column("toxic").to_numpy()
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        codes, counts, distinct = words_of(texts.take(pa.array(order)))
        toxic = toxic[order]
        features = feature_slots(distinct)
        slots = slots_of(features)
        marked = np.isin(features, marks).any(1) if len(distinct) else np.zeros(0, bool)
        ends = np.concatenate([[0], np.cumsum(counts)])
        step = max(min(STEP_WORDS, len(codes) // LEAST_STEPS), 1)
        bounds = [0, *(np.flatnonzero(np.diff(ends[1:] // step)) + 1).tolist(), len(counts)]
        weights, transitions = tagger.weights.astype(float).copy(), tagger.transitions.copy()
        seen, seen_t = np.full(SLOTS + 1, 1.0), np.full((2, 2), 1.0)
        for _ in range(EPOCHS):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = codes[ends[lo] : ends[hi]]
                if not len(own):
                    continue
                types, place = np.unique(own, return_inverse=True)
                tags = marked[own] & np.repeat(toxic[lo:hi] == 1, counts[lo:hi])
                g, t = gradient(slots[types], place, ends[lo : hi + 1] - ends[lo], tags.astype(float), Tagger(weights, transitions))
                g -= DECAY * len(own) * weights
                seen += g * g
                seen_t += t * t
                weights += RATE * g / np.sqrt(seen)
                transitions += RATE * t / np.sqrt(seen_t)
        give_back()
        return pa.table({"words": pa.array([len(codes)], pa.int64()), "weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()),
                         "transitions": pa.array([transitions.astype("<f8").tobytes()], pa.binary())})

    return run


def fit_tagger(sample: DataFrame, rounds: int = ROUNDS) -> Tagger:
    """A tagger from (shard, doc_id, toxic, text) of bounded size.

    The driver sees the significant features and one weight vector of fixed size from each of ``SHARDS`` shards.
    """
    marks = labelling_features(sample)
    tagger = Tagger(np.zeros(SLOTS + 1, np.float32), np.zeros((2, 2)))
    tagger.weights[SLOTS] = -4.0
    for _ in range(rounds):
        shards = sample.groupBy("shard").applyInArrow(_train(marks, tagger), "words long, weights binary, transitions binary")
        found = shards.collect()
        share = np.array([r.words for r in found], float) / max(sum(r.words for r in found), 1)
        weights = sum(s * np.frombuffer(r.weights, "<f4") for s, r in zip(share, found))
        transitions = sum(s * np.frombuffer(r.transitions, "<f8").reshape(2, 2) for s, r in zip(share, found))
        tagger = Tagger(weights.astype(np.float32), transitions)
    return tagger


def learn(documents: DataFrame, labels: DataFrame, fit_rows: dict[int, int] | None = None, rounds: int = ROUNDS) -> Model | None:
    """A model from the labelled documents that are not held out; None without documents of both labels.

    Tagger and document weights are fitted on a sample of about ``fit_rows`` documents of each label at most.
    """
    known = cut_lineage(known_labels(labels.where(~held_out())))
    sample = cut_lineage(sample_texts(documents, bounded_sample(known, fit_rows or FIT_ROWS)))
    if sample.select("toxic").distinct().count() < 2:
        return None
    tagger = fit_tagger(sample, rounds)
    tagged = tag_documents(sample, tagger).join(sample.select("doc_id", "toxic"), "doc_id")
    rows = tagged.select(array_to_vector(F.array(*evidence())).alias("features"), F.col("toxic").cast("double").alias("label"))
    fitted = LogisticRegression(regParam=1e-3, maxIter=50).fit(cut_lineage(rows))
    return Model(tagger, [float(w) for w in fitted.coefficients], float(fitted.intercept))


def tag_texts(texts: pa.Array, tagger: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 of the words of all texts, and the texts' bounds."""
    codes, counts, distinct = words_of(texts)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not len(codes):
        return np.zeros(0), offsets
    emissions = emissions_of(slots_of(feature_slots(distinct)), tagger.weights.astype(float))[codes]
    return chain(emissions, offsets, tagger.transitions)[0], offsets


def spans_of(text: str, marginals: np.ndarray) -> list[dict]:
    """Stretches of words whose marginals reach ``SPAN``: bounds in characters, and the greatest marginal."""
    inside = np.concatenate([[False], marginals >= SPAN, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    words = [m.span() for m in _word.finditer(text)]
    return [
        {"start": words[lo][0], "end": words[hi - 1][1], "chance": float(marginals[lo:hi].max())}
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist())
    ]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
TAGGED = "doc_id long, words long, expected double, spans array<struct<start: bigint, end: bigint, chance: double>>"


def tag_documents(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """(doc_id, words, expected, spans) of each row: number of words, expected number of toxic words (the sum of the
    marginals), and the offending offsets in characters of the whole text.

    A text without words (null, empty, white space) has zeros and no spans. Equal texts get equal results up to rounding,
    whatever else is in the table; repeated rows stay. Only ``doc_id`` and ``text`` are read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(tuple(tagger))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(*sent.value)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                texts = strings_of(part.column(1))
                marginals, offsets = tag_texts(texts, own)
                expected, spans = np.zeros(len(texts)), []
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    expected[i] = marginals[lo:hi].sum()
                    spans.append(spans_of(texts[i].as_py(), marginals[lo:hi]) if marginals[lo:hi].max(initial=0) >= SPAN else [])
                columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(expected), pa.array(spans, SPANS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "expected", "spans"])
            give_back()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, TAGGED)


def evidence() -> list:
    """What a document's score is linear in (before the logistic function): toxic words, and words at all."""
    return [F.log(F.col("expected") + LEAST_EXPECTED), F.log1p("words")]


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, words, expected, spans) of each row, see ``tag_documents``.

    A text without words has the score of no toxic word. Without a model every score is one half, and nothing is tagged.
    """
    if model is None:
        nothing = f"cast(array() as {TAGGED.split('spans ')[1]}) as spans"
        return documents.selectExpr("cast(doc_id as long) doc_id", "0.5d as score", "0L as words", "0.0d as expected", nothing)
    strength = sum((F.lit(w) * x for w, x in zip(model.weights, evidence())), F.lit(model.intercept))
    return tag_documents(documents, model.tagger).select("doc_id", (1 / (1 + F.exp(-strength))).alias("score"), "words", "expected", "spans")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, class and offending spans of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    predicted = (F.col("score") >= TOXIC).cast("int").alias("predicted")
    return score_documents(documents, model).select("doc_id", held_out().alias("held_out"), "score", predicted, "spans")
