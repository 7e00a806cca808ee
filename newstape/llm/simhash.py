"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has a bit where more than half of its shingles' hashes have one. Equal fingerprints are one
node from then on, so copies never meet each other. Fingerprints are cut into segments; two that differ in r bits
differ in at most r // segments bits of some segment. So each is stored under its segments, the small Hamming ball
around each segment is enumerated, tables are joined on segment and key, and the whole distance is verified in the
join. Of a pair only the larger key probes the smaller. The number of segments follows the number of fingerprints, so
that a segment has about as many keys as there are fingerprints; it changes the work, never the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.common import fresh, slices, strings_of
from newstape.llm.components import components
from newstape.session import cut_lineage

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text; zero for a text without words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    flat = flat.filter(pa.array(full))
    data = b" ".join(flat.cast(pa.large_binary()).to_pylist())
    sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    counts = np.diff(ends)
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), shingles)
    first = np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + ends[:-1][text]
    last = np.minimum(first + words, ends[1:][text]) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(begin[first].tolist(), (begin[last] + sizes[last] - 1).tolist())
    hashes = np.fromiter((digest(data[lo:hi], seed) for lo, hi in pairs), np.uint64, len(text))
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        starts = (np.cumsum(shingles) - shingles)[some]
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
            out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_batches(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = fingerprints(strings_of(part.column(1)), words, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def segments_for(count: int, max_bits: int) -> int:
    """Segments with about ``count`` keys each: fewer, longer ones the more fingerprints there are."""
    return max(1, min(max_bits + 1, int(64 / max(12.8, math.log2(max(2, count))))))


def _signed(bits: int) -> int:
    return bits - (bits >> 63 << 64)


def links(nodes: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """Pairs (a, b) of different fingerprints ``fp`` of ``nodes`` that differ in at most ``max_bits`` bits."""
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    stored, probes, low = [], [], 0
    for number, width in enumerate(widths):
        key = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        radius = max_bits // segments
        balls = [_signed(sum(1 << b for b in bits)) for n in range(radius + 1) for bits in combinations(range(width), n)]
        stored.append(nodes.select(F.lit(number).alias("segment"), key.alias("key"), F.col("fp").alias("b")))
        ball = nodes.select(F.lit(number).alias("segment"), key.alias("own"), F.col("fp").alias("a"), F.explode(F.array(*map(F.lit, balls))).alias("flip"))
        probes.append(ball.select("segment", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "own", "a").where("key <= own"))
        low += width
    table, asked = stored[0], probes[0]
    for s, p in zip(stored[1:], probes[1:]):
        table, asked = table.unionAll(s), asked.unionAll(p)
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & ((F.col("own") != asked["key"]) | (F.col("a") < F.col("b")))
    found = asked.join(table, (asked["segment"] == table["segment"]) & (asked["key"] == table["key"]) & near)
    return found.select("a", "b")


def near_duplicates(
    documents: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``documents`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at most ``max_bits`` bits, the
    own included. Null and empty texts have fingerprint zero and are linked like any other. Rows without a doc_id
    are linked too but never name a component. Repeated rows stay.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    prints = cut_lineage(docs.mapInArrow(_fingerprint_batches(words, seed), "doc_id long, fp long"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = links(nodes, max_bits, segments_for(nodes.count(), max_bits))
    member = components(found).withColumnRenamed("node", "fp")
    labelled = nodes.join(member, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The documents whose doc_id names their component; rows without a doc_id stay only where no other would.

    Of rows that repeat a kept doc_id all stay.
    """
    found = near_duplicates(documents, **options)
    name = fresh("_kept", documents.columns)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
