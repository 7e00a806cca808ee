"""Language-model scores by a weighted backoff automaton.

Counts of the n-grams of the training documents define the model

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | h) = (c(h w) + t(h) * P(w | h')) / (c(h) + t(h)),   h' = h without its first word, t(h) = scale * c(h) ** power.

This is Witten-Bell smoothing with the number of distinct followers of h as Heaps' law has it, so that n-gram counts
are all that is gathered; probabilities sum to 1 for every history. The automaton has a state for each history seen
in training, an arc for each n-gram seen, and a failure arc from h to h' with weight t(h) / (c(h) + t(h)).

The whole automaton of a large corpus fits no task. Documents are dealt into blocks of bounded text; each block
asks for the counts of its own distinct n-grams only, builds the part of the automaton that its documents can reach,
and traverses each document once from left to right. Requests and training counts travel together: a block sends
each range of the key space its sorted keys with its own training counts, the task of that range adds them up
(a key comes once from a block, however frequent it is) and answers every block in the order of its keys.

N-grams are known by 64-bit hashes: with n distinct n-grams the chance that any two meet is below n**2 / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import (
    block_of, bucket_bounds, give_back, hashes_of, mix, pack, pack_sorted, slices, strings_of, text_bytes, unpack, unpack_sorted, words_of,
)

#: Texts of a block, in bytes; a block is what one group of a task holds.
BLOCK_BYTES = 4 << 20
#: Distinct n-grams that all blocks together send to one key range, about.
RANGE_KEYS = 2 << 20
#: Words that a lane of the traversal scores.
LANE = 256

#: Words hold no white space, so these two can't be words.
START, END = b" start", b" end"
FOLDS, HELD_OUT_FOLD = 7, 2


class Model(NamedTuple):
    total: int
    distinct: int
    scale: float
    power: float


class NGrams:
    """The n-grams of some texts, each text with a start before and an end behind its words.

    ``grams[k][i]`` is the hash of the k + 1 words that end at slot i, ``used[k][i]`` whether these are in one text,
    ``lengths`` the slots of each text.
    """

    def __init__(self, texts: pa.Array, order: int):
        codes, counts, words = words_of(texts)
        hashes = np.concatenate([hashes_of(words), [np.uint64(xxhash.xxh64_intdigest(w)) for w in (START, END)]])
        self.lengths = counts + 2
        ends = np.cumsum(self.lengths)
        ids = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
        starts = ends - self.lengths
        ids[starts], ids[ends - 1] = len(words), len(words) + 1
        ids[ids == -1] = codes
        reach = np.ones(len(ids), bool)
        reach[starts] = False
        self.starts, self.ends = starts, ends
        self.grams, self.used = [hashes[ids]], [np.ones(len(ids), bool)]
        for _ in range(1, order):
            before = np.concatenate([[np.uint64(0)], self.grams[-1][:-1]])
            self.grams.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + self.grams[0]))
            self.used.append(reach.copy())
            reach &= np.concatenate([[False], reach[:-1]])

    def every(self, of_text: np.ndarray | None = None) -> np.ndarray:
        """All n-grams, or those of the texts for which ``of_text`` holds."""
        slots = True if of_text is None else np.repeat(of_text, self.lengths)
        return np.concatenate([g[u & slots] for g, u in zip(self.grams, self.used)])

    def places(self) -> tuple[int, list[np.ndarray]]:
        """How many distinct n-grams there are, and the place among them, in order, of the one at each slot."""
        every = self.every()
        order = np.argsort(every)
        ascending = every[order]
        step = np.ones(len(every), bool)
        step[1:] = ascending[1:] != ascending[:-1]
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(step) - 1
        out, at = [], 0
        for u in self.used:
            p = np.full(len(u), -1, np.int64)
            p[u] = place[at : (at := at + int(u.sum()))]
            out.append(p)
        return int(step.sum()), out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _requests(order: int, bits: int):
    schema = "bucket int, block int, n int, keys binary, trained binary"

    def one(table: pa.Table) -> pa.Table:
        give_back()
        grams = NGrams(strings_of(table["text"]), order)
        keys = distinct(grams.every())
        training = np.sort(grams.every(~np.array(table["held_out"].to_pylist(), bool)))
        trained = np.searchsorted(training, keys, "right") - np.searchsorted(training, keys, "left")
        block, edges = table["block"][0].as_py(), bucket_bounds(keys, bits)
        rows = [
            (b, block, int(hi - lo), pack_sorted(keys[lo:hi]), pack(trained[lo:hi].astype(np.uint32)))
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
            if hi > lo
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        names = ("bucket", "block", "n", "keys", "trained")
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds))})

    return one, schema


def _answers(table: pa.Table) -> pa.Table:
    """The sums over all blocks, for each block in the order of its own keys."""
    rows = table.select(["n", "keys", "trained"]).to_pylist()
    keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
    trained = np.concatenate([unpack(r["trained"], r["n"], np.uint32) for r in rows])
    order = np.argsort(keys)
    step = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    sums = np.empty(len(keys), np.uint64)
    sums[order] = np.bincount(step, weights=trained[order]).astype(np.uint64)[step]
    ends = np.cumsum([r["n"] for r in rows])
    answers = [pack(sums[e - r["n"] : e]) for r, e in zip(rows, ends)]
    return pa.table(
        {"block": table["block"], "bucket": table["bucket"], "n": table["n"], "sums": pa.array(answers, pa.binary())}
    )


class Automaton:
    """States, arcs and failure arcs that the n-grams of a block can reach.

    A state is a history seen in training, known by its place among the distinct n-grams; the state without history
    has an arc for every word. The arc that leaves a state with a word is the n-gram of both, if training has it:
    ``logp`` is its weight, ``to`` the length of the history it leads to. ``back`` is the weight of the failure arc
    of a state, which leads to the history without its first word.
    """

    def __init__(self, grams: NGrams, size: int, places: list[np.ndarray], counts: np.ndarray, model: Model):
        self.order, self.places, self.seen = len(places), np.stack(places), counts > 0
        prob, self.to = np.zeros(size), np.zeros(size, np.int64)
        unigram = places[0]
        prob[unigram] = (counts[unigram] + 1) / (model.total + model.distinct + 1)
        self.to[unigram] = np.where(self.seen[unigram], min(1, self.order - 1), 0)
        lower = model.scale * counts.astype(float) ** model.power
        for k in range(1, self.order):
            at = np.flatnonzero(grams.used[k])
            at = at[self.seen[places[k][at]]]
            gram, shorter, history = places[k][at], places[k - 1][at], places[k - 1][at - 1]
            prob[gram] = (counts[gram] + lower[history] * prob[shorter]) / (counts[history] + lower[history])
            self.to[gram] = min(k + 1, self.order - 1)
        self.logp = np.log10(prob, where=prob > 0, out=np.zeros(size))
        self.back = np.zeros(size)
        self.back[self.seen] = np.log10(lower[self.seen] / (counts[self.seen] + lower[self.seen]))

    def traverse(self, starts: np.ndarray, ends: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The log10 probability of each text that lies between a start and an end.

        Texts are cut into lanes that go left to right side by side, each carrying its state. The state depends on
        the last ``order - 1`` words only, so a lane reads as many words before its own to reach it.
        """
        counts = -(-(ends - starts - 1) // lane)
        text = np.repeat(np.arange(len(starts)), counts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = starts[text] + 1 + number * lane
        last = np.minimum(first + lane, ends[text])
        at = np.maximum(first - self.order + 1, starts[text])
        by_length = np.argsort(at - last, kind="stable")
        text, first, last, at = text[by_length], first[by_length], last[by_length], at[by_length]
        lengths = last - at
        score, depth = np.zeros(len(text)), np.zeros(len(text), np.int64)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -step, "left"))
            i = at[:n] + step
            counted, d = i >= first[:n], depth[:n]
            gram = self.places[d, i]
            fails = np.flatnonzero((d > 0) & ~self.seen[gram])
            while len(fails):
                score[fails] += self.back[self.places[d[fails] - 1, i[fails] - 1]] * counted[fails]
                d[fails] -= 1
                gram[fails] = self.places[d[fails], i[fails]]
                fails = fails[(d[fails] > 0) & ~self.seen[gram[fails]]]
            score[:n] += self.logp[gram] * counted
            depth[:n] = self.to[gram]
        return np.bincount(text, weights=score, minlength=len(starts))


def _scores(order: int, model: Model):
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def one(docs: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        grams = NGrams(strings_of(docs["text"]), order)
        size, places = grams.places()
        rows = sorted(answers.select(["bucket", "n", "sums"]).to_pylist(), key=lambda r: r["bucket"])
        counts = np.concatenate([np.zeros(0, np.uint64), *(unpack(r["sums"], r["n"], np.uint64) for r in rows)])
        automaton = Automaton(grams, size, places, counts.astype(np.int64), model)
        seen = counts[places[0]]
        words = np.ones(len(seen), bool)
        words[grams.starts] = False
        text = np.repeat(np.arange(docs.num_rows), grams.lengths)[words]
        base = np.log10((seen[words] + 1.0) / (model.total + model.distinct + 1))
        sums = {
            "n_tokens": grams.lengths - 1,
            "n_known": np.bincount(text[seen[words] > 0], minlength=docs.num_rows),
        }
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(pa.int64()), "held_out": docs["held_out"],
                **{name: pa.array(n, pa.int64()) for name, n in sums.items()},
                "base_score": pa.array(np.bincount(text, weights=base, minlength=docs.num_rows), pa.float64()),
                "score": pa.array(automaton.traverse(grams.starts, grams.ends), pa.float64()),
            }
        )

    return one, schema


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and count of the distinct words of each batch, ends included."""
    for batch in batches:
        for part in slices(batch, 0, BLOCK_BYTES):
            codes, counts, words = words_of(strings_of(part.column(0)))
            n = np.append(np.bincount(codes, minlength=len(words)), len(counts))
            hashes = np.append(hashes_of(words), np.uint64(xxhash.xxh64_intdigest(END))).view(np.int64)
            for lo in range(0, len(hashes), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.record_batch({"word": pa.array(hashes[some]), "n": pa.array(n[some], pa.int64())})


def training_totals(training: DataFrame, text: str = "text") -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts; two numbers reach the driver."""
    words = training.select(text).mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    row = words.agg(F.sum("n"), F.count("*")).first()
    return row[0] or 0, row[1]


def held_out(doc_id: str = "doc_id"):
    """Whether a document's fold is the one that training leaves out; documents without an id train."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def score_documents(documents: DataFrame, order: int = 2, scale: float = 2.0, power: float = 0.9) -> DataFrame:
    """Scores ``documents`` (doc_id, text, held_out) by the model of those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score; one row for
    each row given. Null texts are empty (one token: the end). Other columns are ignored. Without any training
    document every word is unseen. Without rows the result is empty. ``order`` is the longest n-gram, ``scale`` and
    ``power`` weigh the shorter history (see above).
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "held_out")
    total, distinct_words = training_totals(docs.where(~F.col("held_out")))
    size = text_bytes(docs)
    blocks = max(1, -(-size // BLOCK_BYTES))
    keys = order * (size // 8 + 1)
    bits = max(0, math.ceil(math.log2(max(1, keys / RANGE_KEYS))))
    dealt = docs.withColumn("block", block_of("doc_id", "text", blocks))
    request, request_schema = _requests(order, bits)
    score, score_schema = _scores(order, Model(total, distinct_words, scale, power))
    answers = (
        dealt.groupBy("block").applyInArrow(request, request_schema)
        .groupBy("bucket").applyInArrow(_answers, "block int, bucket int, n int, sums binary")
    )
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, score_schema)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learning from the folds that are not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(documents.withColumn("held_out", held_out()))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"),
    )


#: Remainder of a document id's CRC-32 in DuckDB SQL (which has no such function): ``crc_table`` and ``fold(n)``.
CRC_TABLE_SQL = """crc_table as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from (select unnest(range(256)) as i)))"""


def crc_mod_sql(modulus: int) -> str:
    return (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), "
        "lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) "
        f"% {modulus}"
    )


OP1_SQL = f"""
with {CRC_TABLE_SQL},
docs as (
  select doc_id, {crc_mod_sql(FOLDS)} = {HELD_OUT_FOLD} as held_out,
    list_concat([' start'], regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x20\\x09-\\x0D]+'), [' end']) as w
  from documents, crc_table),
tokens as (select doc_id, held_out, unnest(w[:-2]) as h, unnest(w[2:]) as w from docs),
words as (select w, count(*) as c from tokens where not held_out group by w),
histories as (select h, count(*) as c from tokens where not held_out group by h),
pairs as (select h, w, count(*) as c from tokens where not held_out group by h, w),
totals as (select coalesce(sum(c), 0) as n, count(*) as v from words),
known as (
  select doc_id, held_out, n, words.c as c, (coalesce(words.c, 0) + 1) / (n + v + 1) as p,
    coalesce(pairs.c, 0) as pc, coalesce(histories.c, 0) as hc
  from tokens cross join totals left join words using (w) left join histories using (h) left join pairs using (h, w))
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n) as bigint) as train_tokens,
  round(sum(log10(p)), 6) as base_score, round(sum(case when hc = 0 then log10(p) else log10((pc + 2 * hc ** 0.9 * p) / (hc + 2 * hc ** 0.9)) end), 6) as score
from known group by doc_id, held_out
"""
