"""Second-order boosted trees for two classes.

Every round fits one tree to gradients g = p - y and Hessians h = p (1 - p) of the logistic loss. A level of the tree is
one pass over the rows: tasks add up g, h and the number of rows for each (node, feature, bin) and one partially
aggregated ``groupBy`` adds the tasks' sums, so what travels is bounded by nodes * features * bins, not by rows. The
driver reads these sums, takes for each node the cut with the largest gain

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

and gives a leaf the weight -G / (H + lambda) times the learning rate. Bins and margins are a table in the shared folder;
margins are written anew every few rounds, the trees since then travel with the tasks, so a lost executor costs its
tasks only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.session import drop_folder, shared_dir

BINS = 256
#: Rounds between two writings of the margins.
STORE_EVERY = 10
#: A gain below this is none; gains that differ by less than this share are equal, and the first cut is taken.
LEAST_GAIN, SAME_GAIN = 1e-6, 1e-9

_NODES = "tree int, node int, feature string, cut double, missing_left boolean, gain double, g double, h double, rows bigint, value double"
_SUMS = "cell bigint, g double, h double, n bigint"


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2i + 1 (bin <= ``bin``) and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    g: np.ndarray
    h: np.ndarray
    rows: np.ndarray
    value: np.ndarray

    @classmethod
    def grown_to(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, int), np.zeros(n))

    def places(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The node every row has come to. ``bins``: rows x features, ``missing``: the bin of missing values by feature."""
        node = np.zeros(len(bins), int)
        row = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.value) + 1)) - 1):
            f = self.feature[node]
            at = bins[row, f]
            left = np.where(at == missing[f], self.missing_left[node], at <= self.bin[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node


@dataclass
class BoostedTrees:
    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    def binned(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Number of cuts not above the value; missing values (NULL, NaN) have a bin of their own behind the others."""
        return np.stack(
            [np.where(np.isnan(x), len(c) + 1, np.searchsorted(c, x, side="right")) for x, c in zip(columns, self.cuts)], axis=1
        )

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.value[tree.places(bins, self.missing)]
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``probability`` of class 1 and ``prediction``; every row and column stays."""
        model = self

        @F.pandas_udf("double")
        def chance(*columns: pd.Series) -> pd.Series:
            z = model.base + model.margins(model.binned([c.to_numpy(float) for c in columns]))
            return pd.Series(1.0 / (1.0 + np.exp(-z)))

        scored = df.withColumn("probability", chance(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))

    def node_rows(self) -> list[tuple]:
        rows = []
        for t, tree in enumerate(self.trees):
            reached = [0]
            for i in reached:
                f = int(tree.feature[i])
                sums = (float(tree.g[i]), float(tree.h[i]), int(tree.rows[i]))
                if f < 0:
                    rows.append((t, i, None, None, None, None, *sums, float(tree.value[i])))
                    continue
                reached += [2 * i + 1, 2 * i + 2]
                cut = float(self.cuts[f][tree.bin[i]])
                rows.append((t, i, self.features[f], cut, bool(tree.missing_left[i]), float(tree.gain[i]), *sums, None))
        return rows

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: cut and gain of a split, weight (times the rate) of a leaf, sums of g and h, rows."""
        return spark.createDataFrame(self.node_rows(), _NODES)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Mean gain of the splits of each feature as a share of all features' mean gains."""
        gains = {f: [] for f in self.features}
        for _, _, feature, _, _, gain, *_ in self.node_rows():
            if feature is not None:
                gains[feature].append(gain)
        means = {f: sum(g) / len(g) if g else 0.0 for f, g in gains.items()}
        total = sum(means.values()) or 1.0
        return spark.createDataFrame([(f, m / total) for f, m in means.items()], "feature string, importance double")

    def save(self, path: str) -> None:
        """The trees as a table of nodes, and one row of what else belongs to them."""
        spark = SparkSession.active()
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        shape = {"features": self.features, "cuts": [list(map(float, c)) for c in self.cuts], "base": self.base, "losses": self.losses}
        depth = int(np.log2(len(self.trees[0].value) + 1)) - 1 if self.trees else 0
        row = [(json.dumps(shape | {"trees": len(self.trees), "depth": depth}),)]
        spark.createDataFrame(row, "shape string").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.active()
        shape = json.loads(spark.read.parquet(f"{path}/shape").first().shape)
        cuts = [np.array(c, float) for c in shape["cuts"]]
        trees = [Tree.grown_to(shape["depth"]) for _ in range(shape["trees"])]
        for r in spark.read.parquet(f"{path}/nodes").toLocalIterator():  # a model's nodes
            tree, i = trees[r.tree], r.node
            tree.g[i], tree.h[i], tree.rows[i] = r.g, r.h, r.rows
            if r.feature is None:
                tree.value[i] = r.value
            else:
                f = shape["features"].index(r.feature)
                tree.feature[i], tree.bin[i] = f, int(np.searchsorted(cuts[f], r.cut))
                tree.missing_left[i], tree.gain[i] = r.missing_left, r.gain
        return cls(shape["features"], cuts, shape["base"], trees, shape["losses"])


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` cuts per feature at its quantiles (at most features * bins numbers are read)."""
    chances = [i / bins for i in range(1, bins)]
    found = rows.approxQuantile(list(features), chances, 0.25 / bins)
    lowest = rows.agg(*[F.min(F.nanvl(F.col(f), F.lit(None))).alias(f"_{i}") for i, f in enumerate(features)]).first()
    # Nothing lies below the smallest value, so it is no cut.
    return [np.array(sorted({q for q in qs if q > low}), float) if qs else np.zeros(0) for qs, low in zip(found, lowest)]


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(features)], axis=1).astype(int)
    return bins, batch.column(features).to_numpy(zero_copy_only=False), batch.column(features + 1).to_numpy(zero_copy_only=False)


def _level_sums(model: BoostedTrees, tree: Tree, level: int, since: int):
    """Sums of g, h and rows by (node of the level, feature, bin); cell -1 holds the loss before the round."""
    count, width, missing = len(model.features), int(model.missing.max()) + 1, model.missing
    first, size = 2**level - 1, 2**level * count * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, n, loss, rows = np.zeros(size), np.zeros(size), np.zeros(size, int), 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, z = _columns(batch, count)
            z = z + model.margins(bins, since)
            p = 1.0 / (1.0 + np.exp(-z))
            loss, rows = loss + (np.logaddexp(0.0, z) - y * z).sum(), rows + len(y)
            node = tree.places(bins, missing) - first
            live = node >= 0
            slope, bend = (p - y)[live], (p * (1 - p))[live]
            for f in range(count):
                cell = (node[live] * count + f) * width + bins[live, f]
                g += np.bincount(cell, slope, size)
                h += np.bincount(cell, bend, size)
                n += np.bincount(cell, minlength=size)
        used = np.flatnonzero(n)
        sums = [np.append(used, -1), np.append(g[used], loss), np.append(h[used], 0.0), np.append(n[used], rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in sums], ["cell", "g", "h", "n"])

    return run, (2**level, count, width)


def _restore_margins(model: BoostedTrees, since: int):
    count = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, z = _columns(batch, count)
            yield batch.set_column(count + 1, "margin", pa.array(z + model.margins(bins, since)))

    return run


def _split_level(model: BoostedTrees, tree: Tree, level: int, sums: np.ndarray, penalty: float, least_bend: float, least_gain: float) -> bool:
    """Best cut of every node of the level; whether any was split. ``sums``: (g, h, rows) x node x feature x bin."""
    grew = False
    for place in range(2**level):
        i = 2**level - 1 + place
        if level and tree.feature[(i - 1) // 2] < 0:
            continue
        best, found = 0.0, None
        total = sums[:, place, 0].sum(axis=1)
        tree.g[i], tree.h[i], tree.rows[i] = total
        for f, cuts in enumerate(model.cuts):
            below = np.cumsum(sums[:, place, f, : len(cuts)], axis=1)
            lost = sums[:, place, f, len(cuts) + 1]
            for missing_left in (False, True) if lost[2] else (False,):
                left = below + lost[:, None] if missing_left else below
                right = total[:, None] - left
                fits = (left[1] >= least_bend) & (right[1] >= least_bend) & (left[2] > 0) & (right[2] > 0)
                if not fits.any():
                    continue
                gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
                gain = np.where(fits, gain, -np.inf)
                k = int(np.argmax(gain >= gain.max() - SAME_GAIN * abs(gain.max())))
                if gain[k] > max(least_gain, LEAST_GAIN) and gain[k] > best * (1 + SAME_GAIN):
                    best, found = gain[k], (f, k, missing_left, left[:, k], right[:, k])
        if found:
            grew = True
            tree.feature[i], tree.bin[i], tree.missing_left[i], tree.gain[i] = *found[:3], best
            for child, part in ((2 * i + 1, found[3]), (2 * i + 2, found[4])):
                tree.g[child], tree.h[child], tree.rows[child] = part
    return grew


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    label: str = "target",
    rounds: int = 100,
    max_depth: int = 3,
    rate: float = 0.1,
    penalty: float = 1.0,
    least_bend: float = 1.0,
    least_gain: float = 0.0,
    bins: int = BINS,
    cuts: Mapping[str, Sequence[float]] | None = None,
) -> BoostedTrees:
    """``penalty`` is lambda, ``least_bend`` the least sum of h in a child, ``least_gain`` the least gain of a split.

    ``cuts`` gives the cuts of every feature instead of its quantiles; a row goes left if its value is below the cut.
    Missing values go to the side that gains more. Rows without a label are left out; the first margin is the logit of
    the share of class 1. No row with a label is an error. Equal gains: first feature, smallest cut.
    """
    features = list(features)
    spark = train.sparkSession
    named = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    rows = train.where(F.col(label).isNotNull()).select(*named, F.col(label).cast("double").alias("_y"))
    share = rows.agg(F.avg("_y")).first()[0]
    if share is None:
        raise ValueError("no row with a label to train on")
    share = min(max(share, 1e-6), 1 - 1e-6)
    if cuts is None:
        places = quantile_cuts(rows, [f"_x{i}" for i in range(len(features))], bins)
    else:
        places = [np.array(sorted(set(cuts[f])), float) for f in features]
    model = BoostedTrees(features, places, float(np.log(share / (1 - share))))
    shape = ", ".join([*[f"b{i} int" for i in range(len(features))], "y double", "margin double"])

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            binned = model.binned(columns[:-1]).astype(np.int32)
            out = [*[pa.array(b) for b in binned.T], pa.array(columns[-1]), pa.array(np.full(len(binned), model.base))]
            yield pa.RecordBatch.from_arrays(out, [*[f"b{i}" for i in range(len(features))], "y", "margin"])

    folder = f"{shared_dir(spark)}/boosting-{uuid.uuid4().hex}"

    def store(df: DataFrame, at: int) -> DataFrame:
        df.write.parquet(f"{folder}/round={at}")
        return spark.read.schema(shape).parquet(f"{folder}/round={at}")

    stored, since = store(rows.mapInArrow(bin_rows, shape), 0), 0
    for t in range(rounds):
        if t - since == STORE_EVERY:
            stored, since, old = store(stored.mapInArrow(_restore_margins(model, since), shape), t), t, since
            drop_folder(spark, f"{folder}/round={old}")
        tree = Tree.grown_to(max_depth)
        for level in range(max_depth):
            run, (nodes, count, width) = _level_sums(model, tree, level, since)
            added = stored.mapInArrow(run, _SUMS).groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
            got = added.toArrow()  # at most nodes * features * bins sums
            cell, *parts = [got.column(c).to_numpy() for c in ("cell", "g", "h", "n")]
            sums = np.zeros((3, nodes * count * width))
            sums[:, cell[cell >= 0]] = np.stack(parts)[:, cell >= 0]
            if level == 0:
                model.losses.append(float(parts[0][cell < 0].sum() / parts[2][cell < 0].sum()))
            if not _split_level(model, tree, level, sums.reshape(3, nodes, count, width), penalty, least_bend, least_gain):
                break
        tree.value = np.where(tree.feature < 0, -rate * tree.g / (tree.h + penalty), 0.0)
        model.trees.append(tree)
    drop_folder(spark, folder)
    return model
