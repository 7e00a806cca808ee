"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the cells floor((a_i . x + b_i) / width) of a few random Gaussian directions. A query
visits its own bucket and perturbed ones, cells one up or down, in the order of their estimated success: the sum of
squared distances to the cell borders that a perturbation crosses. Candidates of all tables are compared by exact
distance in double precision.

Equal vectors are one candidate with its smallest ids, so copies neither fill buckets nor meet each other. Buckets are
dealt into groups of bounded size, large buckets over several; a group keeps the nearest of each query, so rows
grow with the queries and their probes, not with the pairs compared. Width and number of probes are fitted on a
bounded sample so that its recall reaches a target. Queries that find too few candidates search every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from newstape.llm.common import mix
from newstape.session import cut_lineage

TABLES, DIRECTIONS, CELL_WIDTH = 4, 6, 1.5
#: Vectors that width and probes are fitted on, at most about; those that serve as queries; the recall to reach.
SAMPLE, SAMPLE_QUERIES, TARGET = 2000, 64, 0.97
#: Vectors of a group, about.
GROUP_VECTORS = 16_384
PERTURBATIONS = np.array(list(product((0, -1, 1), repeat=DIRECTIONS)), np.int64)


class Hashing(NamedTuple):
    """``scale`` is the spread of a projection, ``probes`` how many buckets of a table a query visits."""

    scale: float
    probes: int
    seed: int = 20

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """Where vectors lie in a table, in cell widths along each direction."""
        draw = np.random.default_rng([self.seed, table, vectors.shape[1]])
        directions = draw.normal(size=(vectors.shape[1], DIRECTIONS))
        shift = draw.uniform(size=DIRECTIONS)
        return vectors @ directions / (self.scale * CELL_WIDTH) + shift

    def bucket(self, cells: np.ndarray, dim: int) -> np.ndarray:
        """A bucket's number, of the whole cells in the last axis."""
        out = np.full(cells.shape[:-1], dim, np.uint64)
        for i in range(DIRECTIONS):
            out = mix(out * np.uint64(31) + cells[..., i].astype(np.int64).view(np.uint64))
        return out.view(np.int64)

    def probe(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """The buckets that each query visits, most promising first."""
        place = self.cells(vectors, table)
        low = np.floor(place)
        inside = place - low
        cost = np.stack([np.zeros_like(inside), inside**2, (1 - inside) ** 2], -1)  # for steps 0, -1, 1
        choice = np.where(PERTURBATIONS == 0, 0, np.where(PERTURBATIONS == -1, 1, 2))
        score = sum(cost[:, i, choice[:, i]] for i in range(DIRECTIONS))
        best = np.argsort(score, 1, kind="stable")[:, : self.probes]
        return self.bucket(low[:, None, :] + PERTURBATIONS[best], vectors.shape[1])


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(1))


def fit(sample: np.ndarray, k: int) -> Hashing:
    """The fewest probes whose recall on the sample reaches ``TARGET``."""
    if len(sample) <= k + 1:
        return Hashing(1.0, len(PERTURBATIONS))
    draw = Hashing(1.0, 1)
    scale = float(np.mean([(draw.cells(sample, t) * CELL_WIDTH).std(0).mean() for t in range(TABLES)])) or 1.0
    whole = Hashing(scale, len(PERTURBATIONS))
    queries = sample[:SAMPLE_QUERIES]
    first = np.full((len(queries), len(sample)), len(PERTURBATIONS))
    for t in range(TABLES):
        own = whole.bucket(np.floor(whole.cells(sample, t)), sample.shape[1])
        for q, probed in enumerate(whole.probe(queries, t)):
            order = np.argsort(probed, kind="stable")
            at = np.minimum(np.searchsorted(probed, own, sorter=order), len(probed) - 1)
            hit = probed[order[at]] == own
            first[q, hit] = np.minimum(first[q, hit], order[at][hit])
    needed = []
    for q, query in enumerate(queries):
        away = distances(sample, query)
        away[q] = np.inf
        needed.extend(first[q, np.argsort(away, kind="stable")[:k]])
    return Hashing(scale, int(min(len(PERTURBATIONS), np.quantile(needed, TARGET, method="higher") + 1)))


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) with the vector as little-endian doubles; -0.0 is 0.0.

    Rows without an id, with a null, empty or zero vector, or with a null or non-finite component are left out, and
    repeated rows count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key is None or not vector or None in vector:
                    continue
                row = np.array(vector, "<f8") + 0.0
                if np.isfinite(row).all() and row.any():
                    ids.append(key)
                    vectors.append(row.tobytes())
            yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "vec": pa.array(vectors, pa.binary())})

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary").distinct()


def _by_size(table: pa.Table | pa.RecordBatch, column: str = "vec") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each vector length, and their vectors as a matrix."""
    raw = table.column(column).to_pylist()
    sizes = np.array([len(v) for v in raw], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(len(rows), -1)


def _shard_of(bucket: np.ndarray, shards: int) -> np.ndarray:
    return (mix(bucket.view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _index(hashing: Hashing, shards: int, chunks: int):
    schema = "part int, shard int, chunk int, bucket long, rep long, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column("rep").to_numpy()
            for rows, vectors in _by_size(batch):
                raw = batch.column("vec").take(pa.array(rows))
                chunk = (mix(reps[rows].view(np.uint64)) % np.uint64(chunks)).astype(np.int32)
                for t in range(TABLES):
                    bucket = hashing.bucket(np.floor(hashing.cells(vectors, t)), vectors.shape[1])
                    yield pa.record_batch(
                        {
                            "part": pa.array(np.full(len(rows), t, np.int32)), "shard": pa.array(_shard_of(bucket, shards)),
                            "chunk": pa.array(chunk), "bucket": pa.array(bucket), "rep": pa.array(reps[rows]), "vec": raw,
                        }
                    )

    return run, schema


def _probes(hashing: Hashing, shards: int, chunks: int, every: bool):
    schema = "part int, shard int, chunk int, query long, vec binary, buckets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, out = batch.column("rep").to_numpy(), []
            for rows, vectors in _by_size(batch):
                raw = batch.column("vec").take(pa.array(rows)).to_pylist()
                for t in range(1 if every else TABLES):
                    probed = hashing.probe(vectors, t)
                    shard = _shard_of(probed, shards)
                    for i in range(len(rows)):
                        for s in range(shards) if every else np.unique(shard[i]).tolist():
                            asked = None if every else probed[i][shard[i] == s].tolist()
                            out.extend((t, s, c, int(reps[rows[i]]), raw[i], asked) for c in range(chunks))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            names = ("part", "shard", "chunk", "query", "vec", "buckets")
            yield pa.record_batch({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(zip(names, kinds))})

    return run, schema


def _nearest(k: int):
    schema = "query long, rep long, score double"

    def run(index: pa.Table, probes: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        asked = list(zip(probes.column("query").to_pylist(), probes.column("vec").to_pylist(), probes.column("buckets").to_pylist()))
        buckets, reps = index.column("bucket").to_numpy(), index.column("rep").to_numpy()
        for rows, vectors in _by_size(index) if len(asked) else ():
            order = rows[np.argsort(buckets[rows], kind="stable")]
            place = np.argsort(buckets[rows], kind="stable")
            own, matrix = buckets[order], vectors[place]
            for query, vec, wanted in asked:
                if len(vec) != matrix.shape[1] * 8:
                    continue
                if wanted is None:
                    at = np.arange(len(own))
                else:
                    lo, hi = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
                    at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if b > a] or [np.zeros(0, np.int64)])
                away, ids = distances(matrix[at], np.frombuffer(vec, "<f8")), reps[order[at]]
                best = np.lexsort((ids, away))[: k + 1]
                found.append((query, ids[best], away[best]))
        return pa.table(
            {
                "query": pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found] or [[]]).astype(np.int64)),
                "rep": pa.array(np.concatenate([i for _, i, _ in found] or [[]]).astype(np.int64)),
                "score": pa.array(np.concatenate([a for _, _, a in found] or [[]]).astype(np.float64)),
            }
        )

    return run, schema


def nearest(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each row for which ``is_query`` holds.

    ``embeddings`` has vec_id and embedding (an array of numbers); a query's own row is no candidate; ties go to the
    smaller vec_id; all candidates come back if they are fewer than ``k``. Vectors of different lengths never meet.
    See ``valid_vectors`` for rows that take no part.
    """
    rows = cut_lineage(valid_vectors(embeddings))
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    distinct = cut_lineage(few.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    count = distinct.count()
    share = max(1, -(-count // SAMPLE))
    sizes = distinct.groupBy(F.octet_length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    chosen = distinct.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0)
    sample = chosen.where(F.octet_length("vec") == (sizes["size"] if sizes else 0)).orderBy(F.xxhash64("rep")).limit(2 * SAMPLE)
    raw = b"".join(r["vec"] for r in sample.select("vec").collect())
    hashing = fit(np.frombuffer(raw, "<f8").reshape(-1, sizes["size"] // 8) if raw else np.zeros((0, 1)), k)
    asked = rows.where(is_query).select("vec", F.col("vec_id").alias("query_id"))
    queries = distinct.join(asked.select("vec").distinct(), "vec", "left_semi").select("rep", "vec")

    shards = max(1, -(-count // GROUP_VECTORS))
    one, schema = _index(hashing, shards, 1)
    largest = distinct.select("rep", "vec").mapInArrow(one, schema).groupBy("part", "shard").count().agg(F.max("count")).first()[0]
    chunks = max(1, -(-(largest or 0) // (4 * GROUP_VECTORS)))
    index_of, index_schema = _index(hashing, shards, chunks)
    index = distinct.select("rep", "vec").mapInArrow(index_of, index_schema)

    def search(of: DataFrame, every: bool) -> DataFrame:
        probe, probe_schema = _probes(hashing, shards, chunks, every)
        near, near_schema = _nearest(k)
        keys = ("part", "shard", "chunk")
        own = index.where("part = 0") if every else index
        met = own.groupBy(*keys).cogroup(of.mapInArrow(probe, probe_schema).groupBy(*keys)).applyInArrow(near, near_schema)
        best = met.groupBy("query", "rep").agg(F.min("score").alias("score"))
        with_ids = best.join(distinct.select("rep", F.explode("ids").alias("vec_id")), "rep")
        order = Window.partitionBy("query").orderBy("score", "vec_id")
        return with_ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "vec_id", "score")

    found = cut_lineage(search(queries, False))
    counts = found.groupBy("query").count().withColumnRenamed("query", "rep")
    short = queries.join(counts, "rep", "left").where(F.coalesce("count", F.lit(0)) < k + 1).select("rep", "vec")
    short = cut_lineage(short)
    if short.take(1):
        again = search(short, True)
        found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(again)
    reps = distinct.select("vec", F.col("rep").alias("query"))
    pairs = asked.join(reps, "vec").select("query_id", "query").join(found, "query").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found of every hundredth row, by Euclidean distance."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
