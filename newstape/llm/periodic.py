"""Periodic runs of words: an online sparse dynamic program over the diagonals of a text against itself.

A diagonal is a lag q; its match length at word i says how many words in a row, up to i, equal the word q places before
them. A run of period q is a diagonal that ends with at least 3q matches (5 for q = 1): length = matches + q.

Every word extends the diagonals of its earlier occurrences. A word that is frequent in a text would extend as many
diagonals as it has occurrences, nearly all of them too short to matter. So a word extends few of them, one for each
context length k = 1, 2, 4, ...: that of the nearest earlier place where the same k words end, if its lag lies in
(k/2, k]. No run is lost: inside a run of smallest period q, with k/2 < q <= k, the k words before any place hold a whole
period, and a block that holds a whole primitive period recurs at multiples of q and nowhere else, so its nearest
earlier place is at lag q. By the same reason such a diagonal neither breaks off nor begins inside a run, and
a diagonal of a multiple of q never arises. A text of n words costs n steps for each context length, whatever words it
has, and contexts that don't recur leave the next lengths.

The steps of a batch of texts run together in numpy: ``lags`` holds the lag that each word extends, and a diagonal ends
where the next word extends another one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newstape.llm.common import give_back, slices, strings_of

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text bytes that are searched together.
BATCH_BYTES = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (runs of anything but ASCII white space) of all texts, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False).astype(np.int64))])
    return words.filter(full), ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def nearest_earlier(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of ``places`` (ascending) the nearest earlier one with the same code, or -1."""
    order = np.argsort(codes, kind="stable")
    same = np.zeros(len(codes), bool)
    same[1:] = codes[order[1:]] == codes[order[:-1]]
    before = np.full(len(codes), -1, np.int64)
    before[order[1:]] = np.where(same[1:], places[order[:-1]], -1)
    return before


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a batch of texts as (start, length, period), by start and period; starts count over the whole batch.

    ``codes`` are the words of all texts, one after the other, as numbers; ``offsets`` are the texts' bounds.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found = []
    # Contexts of k words that end at ``places``, as numbers that are equal for equal words of the same text.
    places = np.arange(n, dtype=np.int64)
    _, context = np.unique(text * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    k, longest = 1, int(np.diff(offsets).max(initial=0)) // LEAST_PERIODS
    while len(places) and k < 2 * longest + 1:
        before = nearest_earlier(context, places)
        lags = np.where(before >= 0, places - before, 0)
        lags[(lags > k) | (2 * lags <= k)] = 0
        # A diagonal goes on while consecutive words extend the same lag; where it ends, its length decides.
        goes_on = (lags[1:] == lags[:-1]) & (places[1:] == places[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        last = np.concatenate([first[1:], [len(places)]]) - 1
        q = lags[first]
        matches = places[last] - places[first] + k
        enough = (q > 0) & (matches + q >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
        found.append(np.stack([places[first] - k + 1 - q, matches + q, q], 1)[enough])
        # Contexts of 2k words: two of k words, the later one with an earlier place of its own.
        own = np.full(n, -1, np.int64)
        own[places] = context
        ahead = places >= k
        left = np.where(ahead, own[np.maximum(places - k, 0)], -1)
        left[ahead] = np.where(text[places[ahead]] == text[places[ahead] - k], left[ahead], -1)
        # A place counts if its context occurs elsewhere in the text too: earlier, or later (the later one looks back to it).
        again = np.bincount(context)[context] > 1
        usable = (left >= 0) & again
        places = places[usable]
        _, context = np.unique(left[usable] * (int(context.max(initial=0)) + 1) + context[usable], return_inverse=True)
        k *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def dropped_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words lie in any run behind its first period."""
    edges = np.bincount(starts + periods, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def looped(n: int, doc_id: int | None) -> np.ndarray:
    """Places that the words of a text are taken from: their own, or for one id in ten a tail that repeats."""
    places = np.arange(n, dtype=np.int64)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def _search(texts: pa.Array, ids: list[int | None] | None):
    """Words of the texts (looped by id, if ids are given), their bounds, and all runs of them."""
    words, offsets = words_in(texts)
    if ids is not None:
        moved = [looped(hi - lo, i) + lo for lo, hi, i in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ids)]
        words = words.take(pa.array(np.concatenate(moved))) if moved else words
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return words, offsets, find_runs(codes, offsets)


def find(documents: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Adds ``runs``, all periodic runs of the text's words by start and period, and ``collapsed``, the words that are
    left without repetitions, joined by one space.

    A run is a longest stretch of words with smallest period q, at least 6 words and 4 periods. Null and empty texts have
    no runs and collapse to the empty text. Every row is searched by itself and whole, however long: repeated rows give
    equal results. Other columns stay; columns called ``runs`` or ``collapsed`` are replaced.
    """
    kept = [c for c in documents.columns if c not in (runs, collapsed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                words, offsets, (starts, lengths, periods) = _search(strings_of(part.column(text)), None)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                bounds = pa.array(np.searchsorted(owner, np.arange(len(offsets))).astype(np.int32))
                fields = [pa.array(starts - offsets[owner]), pa.array(lengths), pa.array(periods)]
                lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                left = pa.array(_joined(words, offsets, dropped_words(len(words), starts, lengths, periods)), pa.string())
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, lists, left], [*kept, runs, collapsed])
            give_back()

    schema = documents.select(kept).schema.add(runs, RUNS).add(collapsed, "string")
    return documents.select(kept).mapInArrow(run, schema)


def _joined(words: pa.Array, offsets: np.ndarray, dropped: np.ndarray) -> list[str]:
    ends = np.concatenate([[0], np.cumsum(~dropped)])[offsets]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(~dropped)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()


DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, BATCH_BYTES):
            ids = part.column(0).to_pylist()
            words, offsets, (starts, lengths, periods) = _search(strings_of(part.column(1)), ids)
            left = _joined(words, offsets, dropped_words(len(words), starts, lengths, periods))
            bounds = np.searchsorted(starts, offsets).tolist()
            rows = []
            for i, own in enumerate(ids):
                mine = slice(bounds[i], bounds[i + 1])
                found = list(zip((starts[mine] - offsets[i]).tolist(), lengths[mine].tolist(), periods[mine].tolist()))
                rows.append((own, len(found), *_strongest(found), _sha(runs_text(found)), _sha(left[i])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*rows))],
                [c.split()[0] for c in DIGEST.split(", ")],
            )
        give_back()


def runs_text(runs: list[tuple[int, int, int]]) -> str:
    return "".join(f"{s},{n},{q}\n" for s, n, q in runs)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, ...]:
    """Start, length, period and exponent of the run with the most periods; the first of equal ones."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(documents: DataFrame) -> DataFrame:
    """Runs of every document's words, one in ten of them (by id) with a tail that repeats: their number, the one with the
    greatest length / period (ties: smallest start, then period), digests of all runs and of the collapsed text.

    One row for each row, repeated ones included. A null text is an empty one: no runs, four nulls, digests of the empty
    text. A null id loops no tail. Only ``doc_id`` and ``text`` are read, whatever other columns there are.
    """
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_digest_batches, DIGEST)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
