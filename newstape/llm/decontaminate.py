"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment decides.

Documents and benchmark items are sequences of plain words (lower case, without marks at their ends). Their units are
words and pairs of neighbouring words. An alignment of m words, p of them right after the one before in both texts, has
at most 2 * m points, less one for each of its m - 1 - p breaks: to reach T points it must share m + p >= T - 1 of the
2 * L - 1 units of an item of L words. So of any 2 * L - T + k units it shares k. The seeds of an item are its so many
rarest units by their frequency in all documents; a passage that holds fewer than k of them cannot reach the threshold,
however it was edited, and one that holds k is aligned with the item. Frequent units seed nothing they need not.

Documents are looked through in overlapping windows, so wide that any alignment that counts lies within one; items of
similar length share a width. The score is the alignment's share of the best possible one.

Of long items passages count as well: an alignment with the points of ``PASSAGE`` matching words is enough, whatever its
share. Items of more than ``WHOLE`` words are looked for in pieces of that length at most, which overlap by half: any
alignment that counts within half a piece of the item is found.

The benchmark is dealt into parts of about ``PART_WORDS`` words by a hash. A part's seeds travel with the tasks, and the documents are
read once for each part: one of bounded size is broadcast, whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import give_back, mix, slices, strings_of, words_of
from newstape.session import cut_lineage

#: Words of the shortest item and the shortest copy.
LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: A copied passage of so many words counts, however small a share of its item it is.
PASSAGE = 50
#: Words of the longest item that is looked for as a whole.
WHOLE = 300
#: Seeds that a passage must hold, of items of up to twice ``PASSAGE`` words; of longer ones half the units it must share.
LEAST_SEEDS = 4
#: Words of the benchmark that travel at once, about.
PART_WORDS = 1_000_000
#: Cells of an alignment row that are filled together, and text bytes that are searched together.
ROW_CELLS, BATCH_BYTES = 1 << 19, 2 << 20
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚–—…·•¡¿"


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct plain words, the words of all texts in a row as places in them, and how many each text has."""
    codes, counts, words = words_of(texts)
    plain = [w.decode().lower().strip(MARKS) for w in words.to_pylist()]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in plain), np.uint64, len(plain))
    some = np.array([bool(w) for w in plain], bool)[codes] if len(codes) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(some)])[np.concatenate([[0], np.cumsum(counts)])]
    return hashes, codes[some], np.diff(kept)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of all texts in a row, and how many each text has."""
    hashes, codes, counts = coded_words(texts)
    return hashes[codes], counts


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(31) + second)


def units_of(words: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs of all texts: hash, text, and the place of the (first) word in its text.

    With ``known``, a flag for each word, only words that have it, and pairs of two such.
    """
    at = np.arange(len(words)) if known is None else np.flatnonzero(known)
    text = np.repeat(np.arange(len(counts)), counts)
    place = at - (np.cumsum(counts) - counts)[text[at]]
    next_too = np.flatnonzero((at[1:] == at[:-1] + 1) & (text[at[1:]] == text[at[:-1]]))
    pairs = pair_hashes(words[at[next_too]], words[at[next_too] + 1])
    return np.concatenate([words[at], pairs]), np.concatenate([text[at], text[at[next_too]]]), np.concatenate([place, place[next_too]])


def places_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in ``known`` (ascending, not empty), and which keys are there at all."""
    code = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return code, known[code] == keys


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = plain_words(strings_of(batch.column("text")))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(words.view(np.int64)))
        yield pa.record_batch({"item_id": batch.column("item_id"), "item_key": batch.column("item_key"), "item": lists})


class Seeds(NamedTuple):
    """Pieces of similar length: ``units`` (ascending) seed ``pieces[starts[i]:starts[i + 1]]``, each ``times``; windows move by ``step``."""

    step: int
    units: np.ndarray
    starts: np.ndarray
    pieces: np.ndarray
    times: np.ndarray


class Benchmark(NamedTuple):
    """Items as sequences of word hashes, the points that an alignment with each must reach, and how far it extends in a
    document beyond a piece; of the pieces their item and how many seeds a window must hold; ``seeds`` by length;
    ``vocabulary``: the words of all items, ascending."""

    ids: list
    keys: np.ndarray
    items: list[np.ndarray]
    least: np.ndarray
    reach: np.ndarray
    owner: np.ndarray
    needed: np.ndarray
    seeds: list
    vocabulary: np.ndarray


def _span(size, points):
    """Words that an alignment with so many points takes of the other text at most."""
    return (size + np.maximum(MATCH * size - points, 0)).astype(np.int64)


def pieces_of(size: int) -> list[tuple[int, int]]:
    """Bounds of the pieces of an item: all of it, or overlapping parts of equal length."""
    halves = 1 if size <= WHOLE else 2 * -(-size // WHOLE)
    if halves == 1:
        return [(0, size)]
    bounds = [k * size // halves for k in range(halves + 1)]
    return list(zip(bounds, bounds[2:]))


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary = shared.value
        for batch in batches:
            for part in slices(batch, 0, BATCH_BYTES):
                hashes, codes, counts = coded_words(strings_of(part.column(0)))
                if not len(codes):
                    continue
                units, _, _ = units_of(hashes[codes], counts, places_in(vocabulary, hashes)[1][codes])
                code, there = places_in(known, units)
                n = np.bincount(code[there], minlength=len(known))
                some = np.flatnonzero(n)
                yield pa.record_batch({"unit": pa.array(known[some].view(np.int64)), "n": pa.array(n[some])})
            give_back()

    return run


def frequencies(documents: DataFrame, units: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """How often the documents hold each unit (ascending), copies included; one row a unit reaches the driver.

    ``vocabulary`` has the words that the units are made of, ascending.
    """
    shared = documents.sparkSession.sparkContext.broadcast((units, vocabulary))
    found = documents.select("text").mapInArrow(_frequencies(shared), "unit long, n long")
    rows = found.groupBy("unit").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(units), np.int64)
    total[np.searchsorted(units, rows.column("unit").to_numpy().view(np.uint64))] = rows.column("n").to_numpy()
    return total


def benchmark_of(rows: pa.Table, documents: DataFrame, threshold: float, n: int, passage: int) -> Benchmark:
    """The items (item_id, item_key, item) of one part, with their seeds; an alignment must have ``n`` words' points in any case."""
    items = [np.array(r, np.int64) for r in rows.column("item").to_pylist()]
    sizes = np.array([len(w) for w in items], np.int64)
    least = np.maximum(np.minimum(np.ceil(threshold * MATCH * sizes - 1e-9), MATCH * passage), MATCH * n).astype(np.int64)
    parts = [(i, begin, end) for i, size in enumerate(sizes.tolist()) for begin, end in pieces_of(size)]
    owner = np.array([i for i, _, _ in parts], np.int64)
    words = [items[i][begin:end].view(np.uint64) for i, begin, end in parts]
    counts = np.array([len(w) for w in words], np.int64)
    units, piece, _ = units_of(np.concatenate(words), counts)
    known, code = np.unique(units, return_inverse=True)
    vocabulary = np.unique(np.concatenate(words))
    common = frequencies(documents, known, vocabulary)
    shared = least[owner] - 1  # units that an alignment that counts must share
    needed = np.minimum(np.where(counts <= 2 * passage, LEAST_SEEDS, (shared + 1) // 2), shared)
    # The rarest units of each piece, all but shared - needed of them.
    order = np.lexsort((code, common[code], piece))
    per_piece = np.bincount(piece, minlength=len(words))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(per_piece) - per_piece, per_piece)
    chosen = order[rank < (per_piece - shared + needed)[piece[order]]]
    span = _span(counts, least[owner])
    width = np.ceil(np.log2(np.maximum(span, 1))).astype(np.int64)
    seeds = []
    for w in np.unique(width):
        own = chosen[width[piece[chosen]] == w]
        pair, times = np.unique(code[own] * len(words) + piece[own], return_counts=True)
        some, starts = np.unique(pair // len(words), return_index=True)
        step = int(span[width == w].max())
        seeds.append(tuple(Seeds(step, known[some], np.append(starts, len(pair)), pair % len(words), times)))
    reach = np.where(sizes > WHOLE, _span(sizes, least), 0)
    return Benchmark(rows.column("item_id").to_pylist(), rows.column("item_key").to_numpy(), items, least, reach, owner, needed, seeds, vocabulary)


def benchmark_parts(documents: DataFrame, benchmark: DataFrame, threshold: float, n: int, passage: int) -> Iterator[Benchmark]:
    """The benchmark's distinct rows of ``n`` words or more, part by part; rows without id or with equal ids stay apart."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    keyed = rows.select("item_id", F.xxhash64("text").alias("item_key"), "text")
    items = cut_lineage(keyed.mapInArrow(_items, "item_id long, item_key long, item array<long>").where(F.size("item") >= n))
    words = items.agg(F.sum(F.size("item"))).first()[0] or 0
    parts = -(-words // PART_WORDS)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "item_key"), F.lit(parts)) == part).orderBy("item_id", "item_key").toArrow()
        if own.num_rows:
            yield benchmark_of(own, documents, threshold, n, passage)


def candidates(units: tuple[np.ndarray, ...], counts: np.ndarray, seeds: Seeds, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, window and item wherever a window holds as many seeds of a piece as an alignment that counts must share.

    ``units``: see ``units_of``. Window k of a text holds the words from k * step to (k + 2) * step.
    """
    owner, needed = bench.owner, bench.needed
    windows = np.where(counts > 0, np.maximum(-(-counts // seeds.step) - 1, 1), 0)
    first = np.cumsum(windows) - windows
    hashes, text, place = units
    code, there = places_in(seeds.units, hashes)
    hit = np.flatnonzero(there)
    code, text, step = code[hit], text[hit], place[hit] // seeds.step
    late = np.minimum(step, windows[text] - 1)
    early = np.minimum(np.maximum(step - 1, 0), late)
    row = np.concatenate([first[text] + late, first[text] + early])
    held = np.unique(row * len(seeds.units) + np.concatenate([code, code]))
    row, code = held // len(seeds.units), held % len(seeds.units)
    # Each seed that a window holds meets the pieces that it seeds.
    many = np.diff(seeds.starts)[code]
    at = np.repeat(seeds.starts[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair, place = np.unique(np.repeat(row, many) * len(owner) + seeds.pieces[at], return_inverse=True)
    enough = np.bincount(place, weights=seeds.times[at], minlength=len(pair)) >= needed[pair % len(owner)]
    row, piece = pair[enough] // len(owner), pair[enough] % len(owner)
    texts = np.searchsorted(first + windows, row, side="right")
    return texts, row - first[texts], owner[piece]


def stretches(text: np.ndarray, window: np.ndarray, item: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Text, item, begin and end of the stretches that an item's overlapping windows of a text make up."""
    order = np.lexsort((window, item, text))
    text, window, item = text[order], window[order], item[order]
    apart = np.ones(len(text), bool)
    apart[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (window[1:] > window[:-1] + 2)
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(text)) - 1
    return text[first], item[first], window[first] * step, np.minimum((window[last] + 2) * step, counts[text[first]])


def _fill(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and where in the text it first ends (exclusive); padding never matches."""
    pairs, width = texts.shape
    above = np.zeros((pairs, width + 1), np.int32)
    best, ends = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    climb = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(items.shape[1]):
        step = np.where(texts == items[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        row = np.maximum(above + GAP, 0)
        row[:, 1:] = np.maximum(row[:, 1:], above[:, :-1] + step)
        row = np.maximum.accumulate(row + climb, axis=1) - climb
        at = row.argmax(1)
        top = row[np.arange(pairs), at]
        better = top > best
        best[better], ends[better] = top[better], at[better]
        above = row
    return best, ends


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs of word sequences, and the begin and end of the text's aligned part."""
    n = len(items)
    score, begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort([len(t) * 4096 + len(i) for i, t in zip(items, texts)], kind="stable")
    lo = 0
    while lo < n:
        hi = lo + 1
        while hi < n and (hi - lo + 1) * len(texts[order[hi]]) <= ROW_CELLS:
            hi += 1
        rows = order[lo:hi]
        tall, wide = max(len(items[r]) for r in rows), max(len(texts[r]) for r in rows)
        # Hashes 0 and 1 stand for padding of either side; a word with such a hash would only miss a match.
        a, b = np.zeros((len(rows), tall), np.int64), np.ones((len(rows), wide), np.int64)
        c, d = a.copy(), b.copy()
        for j, r in enumerate(rows):
            a[j, : len(items[r])], b[j, : len(texts[r])] = items[r], texts[r]
            c[j, : len(items[r])] = items[r][::-1]
        score[rows], end[rows] = _fill(a, b)
        for j, r in enumerate(rows):
            d[j, : end[r]] = texts[r][: end[r]][::-1]
        begin[rows] = end[rows] - _fill(c, d)[1]
        lo = hi
    return score, begin, end


FOUND = "doc_id long, text_key long, item_id long, item_key long, score double, begin long, end long"


def found_in(texts: pa.Array, bench: Benchmark) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item, points, begin and end (words of the text) of all alignments that count."""
    hashes, codes, counts = coded_words(texts)
    if not len(codes):
        return
    words, words_begin = hashes[codes], np.cumsum(counts) - counts
    units = units_of(words, counts, places_in(bench.vocabulary, hashes)[1][codes])
    for given in bench.seeds:
        seeds = Seeds(*given)
        near = candidates(units, counts, seeds, bench)
        if not len(near[0]):
            continue
        stretch = stretches(*near, counts, seeds.step)
        for lo in range(0, len(stretch[0]), 1000):
            text, item, begin, end = (x[lo : lo + 1000] for x in stretch)
            begin, end = np.maximum(begin - bench.reach[item], 0), np.minimum(end + bench.reach[item], counts[text])
            passages = [words[x:y].view(np.int64) for x, y in zip(words_begin[text] + begin, words_begin[text] + end)]
            points, first, last = align([bench.items[i] for i in item], passages)
            good = points >= bench.least[item]
            yield text[good], item[good], points[good], (begin + first)[good], (begin + last)[good]


def _alignments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*shared.value)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                for text, item, points, begin, end in found_in(strings_of(part.column(1)), bench):
                    keys = [xxhash.xxh64_intdigest((part.column(1)[t].as_py() or "").encode(), 42) for t in text.tolist()]
                    whole = np.array([MATCH * len(bench.items[i]) for i in item], float)
                    yield pa.record_batch(
                        {
                            "doc_id": part.column(0).take(pa.array(text)),
                            "text_key": pa.array(np.array(keys, np.uint64).view(np.int64)),
                            "item_id": pa.array([bench.ids[i] for i in item], pa.int64()),
                            "item_key": pa.array(bench.keys[item], pa.int64()),
                            "score": pa.array(points / whole, pa.float64()),
                            "begin": pa.array(begin, pa.int64()), "end": pa.array(end, pa.int64()),
                        }
                    )
            give_back()

    return run


def contaminated(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = LEAST_WORDS, passage: int = PASSAGE
) -> DataFrame:
    """(doc_id, text_key, item_id, item_key, score, begin, end): items that a document holds, copied or edited.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text, others are not read; ``score`` is the best
    alignment's share of a whole copy's, ``threshold`` at least or that of ``passage`` words of the item; begin and end
    are words of the document (of equally good alignments the first). One row for each document and item; ``text_key`` and
    ``item_key`` (XXH64 of the texts) tell rows apart that share an id or have none, equal rows count once. Null and empty
    texts, and items of fewer than ``n`` words, have no row; nor have alignments of fewer points than ``n`` words in a row
    have. Whole texts are read, however long.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    found = documents.sparkSession.createDataFrame([], FOUND)
    for bench in benchmark_parts(docs, benchmark, threshold, n, passage):
        # A plain tuple: broadcast values are unpickled without this package.
        shared = documents.sparkSession.sparkContext.broadcast(tuple(bench))
        found = found.unionByName(docs.mapInArrow(_alignments(shared), FOUND))
    best = found.groupBy("doc_id", "text_key", "item_id", "item_key")
    top = best.agg(F.max(F.struct("score", -F.col("begin"), -F.col("end"))).alias("top"))
    return top.select(
        "doc_id", "text_key", "item_id", "item_key", "top.score", (-F.col("top.col2")).alias("begin"), (-F.col("top.col3")).alias("end")
    )


def _kept(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*shared.value)
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                clean = np.ones(part.num_rows, bool)
                for found in found_in(strings_of(part.column(text)), bench):
                    clean[found[0]] = False
                yield part.filter(pa.array(clean))
            give_back()

    return run


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = LEAST_WORDS, passage: int = PASSAGE
) -> DataFrame:
    """The documents that hold no item, with all their columns; rows are kept or dropped as they are read, none is shuffled.

    Repeated rows and rows without an id stay or go each by its own text; null and empty texts stay.
    """
    clean = documents
    for bench in benchmark_parts(documents, benchmark, threshold, n, passage):
        shared = documents.sparkSession.sparkContext.broadcast(tuple(bench))
        clean = clean.mapInArrow(_kept(shared, "text"), documents.schema)
    return clean


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its alignment."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key", "item_key")
