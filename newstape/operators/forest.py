"""Random forest for two classes with neither a depth cap nor bins: trees grow until their leaves are pure.

Equal rows are merged first; a tree takes a merged row as often as a Poisson draw says that hangs on the row's values, the
tree and the seed only, so tasks can be run again. A node with more than ``group_rows`` merged rows is split by two passes
over all rows: ranges of its features, then counts per class in equal steps of those ranges, both partially aggregated;
as every child has ranges of its own, steps become as fine as the values. Smaller nodes are dealt out as (tree, node) groups,
each of which is grown to the end in one task with exact splits (midpoints between values, Gini impurity).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.session import drop_folder, shared_dir

GROUP_ROWS = 65_536
STEPS = 64
#: Nodes that one reading of the rows splits, and nodes of trees that one function for prediction holds.
NODES_AT_ONCE, NODES_HELD = 2_000, 2_000_000

LEAF, GROUP = -1, -2
_NODES = "tree int, part int, node int, feature int, threshold double, left int, right int, chance double"
NODE_COLUMNS = ["feature", "threshold", "left", "right", "chance"]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def draws(key: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree takes each merged row: Poisson with the number of its copies as mean (normal from 40 on)."""
    u, v = _mixed(key, 2 * (seed * 1_000_003 + tree) + 1), _mixed(key, 2 * (seed * 1_000_003 + tree) + 2)
    mean = copies.astype(float)
    many = np.maximum(np.rint(mean + np.sqrt(mean) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)), 0)
    small = np.minimum(mean, 40.0)
    out, term = np.zeros(len(key)), np.exp(-small)
    below = term.copy()
    for k in range(1, 120):
        more = u > below
        if not more.any():
            break
        out += more
        term = term * small / k
        below = below + term
    return np.where(mean >= 40, many, out).astype(np.int64)


@dataclass
class Nodes:
    """A tree in lists: a row goes left if its value is at most the threshold; a missing value goes right."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    chance: list[float] = field(default_factory=list)

    def add(self, feature: int = LEAF, threshold: float = 0.0, left: int = 0, right: int = 0, chance: float = 0.0) -> int:
        for name, value in zip(NODE_COLUMNS, (feature, threshold, left, right, chance)):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        return tuple(np.array(getattr(self, n), k) for n, k in zip(NODE_COLUMNS, kinds))


def places(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node (leaf, or node not grown yet) that each row comes to."""
    feature, threshold, left, right, _ = tree
    node = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[node] >= 0)
    while len(going):
        at = node[going]
        goes = x[going, feature[at]] <= threshold[at]
        node[going] = np.where(goes, left[at], right[at])
        going = going[feature[node[going]] >= 0]
    return node


def impurity(ups: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Half the Gini impurity times the weight of the rows."""
    return ups * (all_ - ups) / np.maximum(all_, 1)


def best_cut(values: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float] | None:
    """(impurity of both sides, threshold) of the best exact split; None for a constant."""
    order = np.argsort(values, kind="stable")
    x, up, all_ = values[order], np.cumsum((w * y)[order]), np.cumsum(w[order])
    ends = np.flatnonzero(x[:-1] < x[1:])
    if not len(ends):
        return None
    score = impurity(up[ends], all_[ends]) + impurity(up[-1] - up[ends], all_[-1] - all_[ends])
    i = ends[int(np.argmin(score))]
    middle = x[i] + (x[i + 1] - x[i]) / 2
    return float(score.min()), float(middle if x[i] <= middle < x[i + 1] else x[i])


def grow_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, tried: int, seed: Sequence[int]) -> Nodes:
    """A tree to its end: ``tried`` features drawn anew for each node, more only if those are constant in it."""
    nodes, draw = Nodes(), np.random.default_rng(list(seed))
    waiting = [(nodes.add(), np.arange(len(y)))]
    while waiting:
        i, rows = waiting.pop()
        ups, all_ = (w[rows] * y[rows]).sum(), w[rows].sum()
        nodes.chance[i] = float(ups / all_)
        if ups in (0, all_):
            continue
        best, seen = None, 0
        for f in draw.permutation(x.shape[1]):
            found = best_cut(x[rows, f], y[rows], w[rows])
            if found is None:
                continue
            seen += 1
            if best is None or found[0] < best[0]:
                best = (*found, int(f))
            if seen == tried:
                break
        if best is None:
            continue
        goes = x[rows, best[2]] <= best[1]
        nodes.feature[i], nodes.threshold[i] = best[2], best[1]
        nodes.left[i], nodes.right[i] = nodes.add(), nodes.add()
        waiting += [(nodes.right[i], rows[~goes]), (nodes.left[i], rows[goes])]
    return nodes


@dataclass
class Forest:
    features: list[str]
    trees: list[tuple[np.ndarray, ...]]

    def predict(self, df: DataFrame) -> DataFrame:
        """``probability`` (mean of the trees' leaves) and ``prediction``; every row and column stays. Trees travel with the
        tasks, ``NODES_HELD`` nodes at a time, so one tree must fit into a task's memory."""
        parts, held = [[]], 0
        for tree in self.trees:
            if parts[-1] and held + len(tree[0]) > NODES_HELD:
                parts, held = [*parts, []], 0
            parts[-1].append(tree)
            held += len(tree[0])

        def adder(part):
            @F.pandas_udf("double")
            def chances(*columns: pd.Series) -> pd.Series:
                x = np.stack([c.to_numpy(float) for c in columns], axis=1)
                return pd.Series(sum(t[4][places(t, x)] for t in part))

            return chances

        values = [F.col(f).cast("double") for f in self.features]
        total = sum((adder(p)(*values) for p in parts[1:]), adder(parts[0])(*values))
        scored = df.withColumn("probability", total / F.lit(float(len(self.trees))))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def nodes(self, spark: SparkSession) -> DataFrame:
        tables = []
        for t, tree in enumerate(self.trees):
            columns = [np.full(len(tree[0]), t, np.int32), np.zeros(len(tree[0]), np.int32), np.arange(len(tree[0]), dtype=np.int32), *tree]
            tables.append(pa.table([pa.array(c) for c in columns], ["tree", "part", "node", *NODE_COLUMNS]))
        return spark.createDataFrame(pa.concat_tables(tables)).drop("part")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.features,)], "features array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, path: str) -> Forest:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/nodes").withColumn("part", F.lit(0))
        return cls(list(spark.read.parquet(f"{path}/shape").first().features), _joined_trees(rows, {}))


def _joined_trees(rows: DataFrame, tops: dict[int, tuple[Nodes, dict[int, int]]]) -> list[tuple[np.ndarray, ...]]:
    """Whole trees from their upper nodes (``tops``: nodes and, by the node grown apart, its part) and the parts below."""
    table = rows.toPandas().sort_values(["tree", "part", "node"])
    trees = {}
    for tree, own in table.groupby("tree"):
        top, hangs = tops.get(tree, (Nodes(), {}))
        blocks, size = [np.array(v) for v in top.arrays()], len(top.feature)
        starts = {}
        pieces = [blocks]
        for part, p in own.groupby("part"):
            starts[part] = size
            feature, threshold, left, right, chance = (p[c].to_numpy() for c in NODE_COLUMNS)
            pieces.append([feature, threshold, left + size, right + size, chance])
            size += len(p)
        whole = [np.concatenate(c) for c in zip(*pieces)]
        for node, part in hangs.items():
            for i, c in enumerate(whole):
                c[node] = c[starts[part]]
        trees[tree] = tuple(c.astype(k) for c, k in zip(whole, (np.int32, np.float64, np.int32, np.int32, np.float64)))
    for tree, (top, _) in tops.items():
        trees.setdefault(tree, top.arrays())
    return [trees[t] for t in sorted(trees)]


def _read(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.stack(columns[:features], axis=1), columns[features].astype(np.int64), columns[features + 1], columns[features + 2]


def _taken(batch: pa.RecordBatch, features: int, tops: dict, seed: int, bootstrap: bool):
    """For each tree: (tree, values, labels, draws, node) of the rows it takes."""
    x, y, copies, key = _read(batch, features)
    for tree, top in tops.items():
        w = draws(key, copies, tree, seed) if bootstrap else copies
        used = np.flatnonzero(w)
        yield tree, x[used], y[used], w[used], places(top, x[used])


def _ranges(tops: dict, slots: dict[tuple[int, int], int], features: int, seed: int, bootstrap: bool):
    """Smallest and largest value of each feature, rows, weight and weight of class 1 of every node in work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((len(slots), features), np.inf), np.full((len(slots), features), -np.inf)
        sums = np.zeros((len(slots), 3))
        for batch in batches:
            for tree, x, y, w, node in _taken(batch, features, tops, seed, bootstrap):
                for n in np.unique(node):
                    slot = slots.get((tree, int(n)))
                    if slot is None:
                        continue
                    own = node == n
                    low[slot], high[slot] = np.minimum(low[slot], x[own].min(axis=0)), np.maximum(high[slot], x[own].max(axis=0))
                    sums[slot] += own.sum(), w[own].sum(), (w * y)[own].sum()
        for slot in np.flatnonzero(sums[:, 0]):
            cells = pa.array(np.full(features, slot)), pa.array(np.arange(features)), pa.array(low[slot]), pa.array(high[slot])
            yield pa.RecordBatch.from_arrays([*cells, *[pa.array(np.full(features, s)) for s in sums[slot]]], ["slot", "f", "low", "high", "n", "w", "up"])

    return run


def _counts(tops: dict, slots: dict[tuple[int, int], int], edges: dict[int, dict[int, np.ndarray]], features: int, seed: int, bootstrap: bool):
    """Weight and weight of class 1 by (node, feature tried, step of its range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for tree, x, y, w, node in _taken(batch, features, tops, seed, bootstrap):
                for n in np.unique(node):
                    slot = slots.get((tree, int(n)))
                    if slot not in edges:
                        continue
                    own = node == n
                    for f, cuts in edges[slot].items():
                        step = np.searchsorted(cuts, x[own, f], side="left")
                        both = np.stack([np.bincount(step, v[own], STEPS) for v in (w, w * y)])
                        sums[slot, f] = sums.get((slot, f), 0) + both
        for (slot, f), both in sums.items():
            used = np.flatnonzero(both[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (np.full(len(used), slot), np.full(len(used), f), used, both[0][used], both[1][used])], ["slot", "f", "step", "w", "up"]
            )

    return run


def _split_large(stored: DataFrame, tops: dict[int, Nodes], features: int, tried: int, seed: int, bootstrap: bool, group_rows: int) -> None:
    """Splits nodes until none has more than ``group_rows`` merged rows; what is left to grow is marked ``GROUP``."""
    work = [(t, 0) for t in tops]
    for t in tops:
        tops[t].feature[0] = GROUP
    while work:
        now, work = work[:NODES_AT_ONCE], work[NODES_AT_ONCE:]
        slots = {place: i for i, place in enumerate(now)}
        arrays = {t: tops[t].arrays() for t in {t for t, _ in now}}
        ranges = stored.mapInArrow(_ranges(arrays, slots, features, seed, bootstrap), "slot long, f long, low double, high double, n double, w double, up double")
        ranges = ranges.groupBy("slot", "f").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("n", "w", "up")])
        edges: dict[int, dict[int, np.ndarray]] = {}
        for slot, own in ranges.toPandas().sort_values(["slot", "f"]).groupby("slot"):  # nodes * features rows
            tree, node = now[slot]
            n, w, up = own.iloc[0][["n", "w", "up"]]
            wide = [int(f) for f, a, b in zip(own.f, own.low, own.high) if a < b]
            if up in (0, w) or not wide:
                tops[tree].feature[node], tops[tree].chance[node] = LEAF, float(up / w)
            elif n > group_rows:
                order = [f for f in np.random.default_rng([seed, tree, node]).permutation(features) if f in wide][:tried]
                low, high = own.low.to_numpy(), own.high.to_numpy()
                edges[slot] = {int(f): np.linspace(low[f], high[f], STEPS + 1)[1:-1] for f in order}
        if not edges:
            continue
        counts = stored.mapInArrow(_counts(arrays, slots, edges, features, seed, bootstrap), "slot long, f long, step long, w double, up double")
        counts = counts.groupBy("slot", "f", "step").agg(F.sum("w").alias("w"), F.sum("up").alias("up")).toPandas()  # nodes * features * steps rows
        for slot, own in counts.groupby("slot"):
            tree, node = now[slot]
            best = None
            for f in edges[slot]:
                cells = own[own.f == f].sort_values("step")
                all_, ups, step = cells.w.cumsum().to_numpy(), cells.up.cumsum().to_numpy(), cells.step.to_numpy()
                score = impurity(ups[:-1], all_[:-1]) + impurity(ups[-1] - ups[:-1], all_[-1] - all_[:-1])
                if len(score) and (best is None or score.min() < best[0]):
                    best = float(score.min()), f, float(edges[slot][f][step[int(np.argmin(score))]])
            top = tops[tree]
            top.feature[node], top.threshold[node] = best[1], best[2]
            top.left[node], top.right[node] = top.add(GROUP), top.add(GROUP)
            work += [(tree, top.left[node]), (tree, top.right[node])]


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str = "target",
    trees: int = 100,
    seed: int = 42,
    tried: int | None = None,
    bootstrap: bool = True,
    group_rows: int = GROUP_ROWS,
) -> Forest:
    """``tried`` features are looked at for each split (the root of their number, if not given). ``bootstrap=False`` lets
    every tree see all rows. Rows with a missing feature or label take no part; no row at all is an error."""
    features = list(features)
    spark = train.sparkSession
    count, tried = len(features), tried or max(1, math.isqrt(len(features)))
    values = [F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"x{i}") for i, f in enumerate(features)]
    named = [f"x{i}" for i in range(count)]
    rows = train.select(*values, F.col(label).cast("int").alias("y")).na.drop()
    merged = rows.groupBy(*named, "y").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.xxhash64(*named, "y"))
    folder = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    merged.write.parquet(f"{folder}/rows")
    stored = spark.read.schema(merged.schema).parquet(f"{folder}/rows")
    found, ups, all_ = stored.agg(F.count(F.lit(1)), F.sum(F.col("y") * F.col("copies")), F.sum("copies")).first()
    if not found:
        raise ValueError("no row with features and label to train on")
    tops = {t: Nodes() for t in range(trees)}
    for top in tops.values():
        top.add(GROUP, chance=ups / all_)  # stays so in a tree that draws no row
    if found > group_rows:
        _split_large(stored, tops, count, tried, seed, bootstrap, group_rows)
    arrays = {t: top.arrays() for t, top in tops.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, x, y, w, node in _taken(batch, count, arrays, seed, bootstrap):
                own = np.flatnonzero(arrays[tree][0][node] == GROUP)
                columns = [np.full(len(own), tree), node[own], *x[own].T, y[own], w[own]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "part", *named, "y", "w"])

    def grow(group: pa.Table) -> pa.Table:
        tree, part = group.column("tree")[0].as_py(), group.column("part")[0].as_py()
        x = np.stack([group.column(n).to_numpy() for n in named], axis=1)
        y, w = group.column("y").to_numpy(), group.column("w").to_numpy()
        grown = grow_whole(x, y, w, tried, (seed, tree, part)).arrays()
        size = len(grown[0])
        heads = [np.full(size, tree, np.int32), np.full(size, part, np.int32), np.arange(size, dtype=np.int32)]
        return pa.table([pa.array(c) for c in (*heads, *grown)], ["tree", "part", "node", *NODE_COLUMNS])

    shape = ", ".join(["tree long, part long", *[f"{n} double" for n in named], "y long, w long"])
    parts = stored.mapInArrow(deal, shape).groupBy("tree", "part").applyInArrow(grow, _NODES)
    parts.write.parquet(f"{folder}/nodes")
    hangs = {t: (top, {i: i for i, f in enumerate(top.feature) if f == GROUP}) for t, top in tops.items()}
    grown = _joined_trees(spark.read.schema(_NODES).parquet(f"{folder}/nodes"), hangs)
    drop_folder(spark, folder)
    return Forest(features, grown)
