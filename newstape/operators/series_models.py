"""One logistic regression per series, all of them fitted together.

Newton's method for every model at once: an iteration joins the models' weights to the rows, adds up gradients and
Hessians in one partially aggregated ``groupBy``, and solves one small system per model. Neither the number of series nor
the rows of a hot one reach the driver or a single task; it reads one row per iteration, the number of models
that still move. The penalty is L2 of strength 1/C on the summed loss, without the intercept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newstape.operators.blocks import as_keys, null_safe
from newstape.operators.joins import join_sentiment
from newstape.operators.modeling import evaluate_predictions, prepare_data, standardize
from newstape.operators.ordering import time_series_folds
from newstape.operators.series import FEATURES, create_features
from newstape.session import cut_lineage

#: Largest entry of the gradient of a finished model, per training row.
TOLERANCE = 1e-10
STEPS = 60

_STATE = "weights array<double>, tried array<double>, best double, loss double, gradient double, iterations int, moving boolean"


def _linear(weights: str, features: Sequence[str]) -> Column:
    """Weights times features plus the intercept, which is the last weight."""
    z = F.get(weights, F.lit(len(features)))
    for i, f in enumerate(features):
        z = z + F.get(weights, F.lit(i)) * F.col(f)
    return z


def _sums(features: Sequence[str], label: str, weight: Column) -> list[Column]:
    """Loss, gradient and upper half of the Hessian of the unpenalised loss."""
    z = F.col("_z")
    chance = 1 / (1 + F.exp(-z))
    xs = [*[F.col(f) for f in features], F.lit(1.0)]
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col(label) * z
    slope, bend = weight * (chance - F.col(label)), weight * chance * (1 - chance)
    n = len(xs)
    return [
        F.sum(weight * loss).alias("_loss"),
        F.array(*[F.sum(slope * x) for x in xs]).alias("_slopes"),
        F.array(*[F.sum(bend * xs[i] * xs[j]) for i in range(n) for j in range(i, n)]).alias("_bends"),
    ]


def _stepper(features: int, c: float, tolerance: float):
    """One step of every model: half way back if the last one made the loss larger, else Newton's."""
    size = features + 1
    upper = np.triu_indices(size)
    penalty = np.append(np.full(features, 1.0 / c), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tried, kept = np.stack(batch["tried"]), np.stack(batch["weights"])
            slopes = np.stack(batch["_slopes"]) + penalty * tried
            loss = batch["_loss"].to_numpy() + (penalty * tried**2).sum(1) / 2
            bends = np.zeros((len(batch), size, size))
            bends[:, upper[0], upper[1]] = bends[:, upper[1], upper[0]] = np.stack(batch["_bends"])
            bends += np.diag(penalty)
            best = batch["best"].to_numpy()
            worse = loss > best + 1e-12 * np.abs(best)
            largest = np.abs(slopes).max(1)
            # Beyond double precision a step no longer lowers the loss: the model stays where it is.
            stuck = worse & (np.abs(tried - kept).max(1) <= 1e-13 * (1 + np.abs(kept).max(1)))
            move = np.linalg.solve(bends, slopes[:, :, None])[:, :, 0]
            nearer = (tried + kept) / 2
            done = ~worse & (largest <= tolerance * batch["_rows"].to_numpy())
            ahead = np.where(worse[:, None], nearer, tried - move)
            out = batch.drop(columns=["_loss", "_slopes", "_bends"])
            out["weights"] = list(np.where(worse[:, None], kept, tried))
            out["tried"] = list(np.where((done | stuck)[:, None], tried, ahead))
            out["best"] = np.where(worse, best, loss)
            out["loss"] = out["best"]
            out["gradient"] = np.where(worse, batch["gradient"], largest)
            out["iterations"] = batch["iterations"] + 1
            out["moving"] = ~(done | stuck)
            yield out

    return run


@null_safe
def fit_logistic(
    rows: DataFrame,
    features: Sequence[str],
    keys: str | Sequence[str] = "ticker",
    label: str = "target",
    weight: str | None = None,
    c: float = 1.0,
    tolerance: float = TOLERANCE,
    steps: int = STEPS,
) -> DataFrame:
    """One row per series: ``weights`` (of the features, then the intercept), ``loss``, ``gradient`` (its largest entry),
    ``iterations``, ``rows`` and ``positives``.

    Rows with a NULL feature, label or weight are left out. A series of one class only has no weights.
    """
    keys, features = as_keys(keys), list(features)
    named = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    table = rows.select(*keys, *named, F.col(label).cast("double").alias("_y"), own.alias("_w"))
    xs = [f"_x{i}" for i in range(len(features))]
    table = cut_lineage(table.na.drop(subset=[*xs, "_y", "_w"]))
    counts = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_y") > 0.5).alias("_positives"))
    zeros = F.array(*[F.lit(0.0)] * (len(features) + 1))
    state = counts.select(
        *keys, "_rows", "_positives", zeros.alias("weights"), zeros.alias("tried"), F.lit(float("inf")).alias("best"),
        F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("gradient"), F.lit(0).alias("iterations"),
        F.col("_positives").between(1, F.col("_rows") - 1).alias("moving"),
    )
    state = cut_lineage(state)
    single = state.where(~F.col("moving"))
    finished, state = [], state.where("moving")
    shape = ", ".join([*[f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys], "_rows long, _positives long", _STATE])
    for _ in range(steps):
        met = table.join(state.select(*keys, "tried"), keys).withColumn("_z", _linear("tried", xs))
        sums = met.groupBy(*keys).agg(*_sums(xs, "_y", F.col("_w")))
        state = cut_lineage(state.join(sums, keys).mapInPandas(_stepper(len(features), c, tolerance), shape))
        finished.append(state.where(~F.col("moving")))
        state = state.where("moving")
        if state.isEmpty():
            break
    out = state
    for part in finished:
        out = out.unionByName(part)
    fitted = out.select(*keys, "weights", "loss", "gradient", "iterations", F.col("_rows").alias("rows"), F.col("_positives").alias("positives"))
    nothing = single.select(
        *keys, F.lit(None).cast("array<double>").alias("weights"), "loss", "gradient", "iterations",
        F.col("_rows").alias("rows"), F.col("_positives").alias("positives"),
    )
    return fitted.unionByName(nothing)


@null_safe
def predict_logistic(
    rows: DataFrame, models: DataFrame, features: Sequence[str], keys: str | Sequence[str] = "ticker"
) -> DataFrame:
    """The rows with ``probability`` and ``prediction`` of their own series' model.

    Where training saw one class only, that class is predicted; a series without a model has NULLs.
    """
    keys = as_keys(keys)
    known = models.select(*keys, F.col("weights").alias("_weights"), (F.col("positives") / F.col("rows")).alias("_share"))
    met = rows.join(known, keys, "left")
    chance = F.when(F.col("_weights").isNull(), F.col("_share")).otherwise(1 / (1 + F.exp(-_linear("_weights", features))))
    scored = met.withColumn("probability", chance)
    return scored.withColumn("prediction", (F.col("probability") > 0.5).cast("int")).drop("_weights", "_share")


def coefficients(models: DataFrame, features: Sequence[str], keys: str | Sequence[str] = "ticker") -> DataFrame:
    """(keys, feature, coefficient), one row per weight; the intercept is called so."""
    names = F.array(*[F.lit(f) for f in [*features, "intercept"]])
    pairs = F.inline(F.arrays_zip(names.alias("feature"), F.col("weights").alias("coefficient")))
    return models.where(F.col("weights").isNotNull()).select(*as_keys(keys), pairs)


def train_by_series(
    bars: DataFrame,
    daily: DataFrame | None = None,
    features: Sequence[str] | None = None,
    test_size: float = 0.2,
    fit_scope: str = "train",
    keys: str | Sequence[str] = "ticker",
    least_rows: int = 0,
) -> dict[str, DataFrame]:
    """Labels, splits and scales every series, fits a model of its own and rates it on its test rows.

    Returns ``models``, ``predictions`` (test rows), ``results`` (one row of metrics per series) and the
    prepared rows. Series below ``least_rows`` labelled rows are left out.
    """
    keys = as_keys(keys)
    prepared, found = prepare_data(bars, daily, 1, test_size, fit_scope, keys)
    names = list(features or found)
    prepared = cut_lineage(_long_enough(prepared, keys, least_rows))
    models = fit_logistic(prepared.where("role = 'train'"), names, keys)
    predictions = predict_logistic(prepared.where("role = 'test'"), models, names, keys)
    results = evaluate_predictions(predictions, "logistic_regression", keys)
    return {"models": models, "predictions": predictions, "results": results, "prepared": prepared}


@null_safe
def _long_enough(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    if least <= 0:
        return rows
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(enough, keys, "left_semi")


@null_safe
def balanced_by_series(train: DataFrame, keys: Sequence[str], label: str = "target") -> DataFrame:
    """``weight`` = n / (2 * n_class) inside each series."""
    counts = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_ups"))
    own = F.when(F.col(label) == 1, F.col("_ups")).otherwise(F.col("_n") - F.col("_ups"))
    return train.join(counts, keys).withColumn("weight", F.col("_n") / (2.0 * own)).drop("_n", "_ups")


def cross_validate_by_series(
    bars: DataFrame,
    daily: DataFrame,
    features: Sequence[str] = FEATURES,
    least_rows: int = 50,
    least_train: int = 30,
    keys: str | Sequence[str] = "ticker",
    folds: int | None = None,
    fit_scope: str = "all",
) -> dict[str, DataFrame]:
    """Expanding-window validation of a balanced logistic regression for every series; all folds of all
    series are fitted together.

    ``fit_scope='all'`` scales a series once, with its test folds included, ``'train'`` every fold by its training rows.
    Returns ``folds`` (rows, majority class, its accuracy as ``baseline``, ``accuracy``), ``summary`` (means over
    the folds of a series) and ``importance`` (mean coefficient per series and feature). Series below ``least_rows`` rows
    are left out; folds with fewer training rows than ``least_train`` or with one class have no accuracy.
    """
    keys, features = as_keys(keys), list(features)
    rows = create_features(join_sentiment(bars, daily, keys), label=True, keys=keys)
    complete = _long_enough(rows.na.drop(subset=[*features, "target"]), keys, least_rows)
    scaled = standardize(complete, features, keys) if fit_scope == "all" else complete
    long = time_series_folds(scaled, folds, keys)
    parts = [*keys, "fold"]
    if fit_scope == "train":
        long = standardize(long, features, parts, F.col("role") == "train")
    long = cut_lineage(long)
    models = fit_logistic(balanced_by_series(long.where("role = 'train'"), parts), features, parts, weight="weight")
    models = models.where((F.col("rows") >= least_train) & F.col("weights").isNotNull())
    return _rated(long, models, features, keys) | {"models": models}


def _rated(long: DataFrame, models: DataFrame, features: list[str], keys: list[str]) -> dict[str, DataFrame]:
    parts = [*keys, "fold"]
    train, up, down = F.col("role") == "train", F.col("target") == 1, F.col("target") == 0
    sizes = long.groupBy(*parts).agg(
        F.count_if(train).alias("train_rows"), F.count_if(train & up).alias("_ups"),
        F.count_if(~train).alias("test_rows"), F.count_if(~train & up).alias("_test_ups"), F.count_if(~train & down).alias("_test_downs"),
    )
    majority = (F.col("_ups") > F.col("train_rows") - F.col("_ups")).cast("int")
    sizes = sizes.withColumn("majority_class", majority)
    agree = F.when(F.col("majority_class") == 1, F.col("_test_ups")).otherwise(F.col("_test_downs"))
    sizes = sizes.select(*parts, "train_rows", "test_rows", "majority_class", F.coalesce(F.try_divide(agree, "test_rows"), F.lit(0.0)).alias("baseline"))
    scored = predict_logistic(long.where(~train), models, features, parts)
    hits = scored.groupBy(*parts).agg(F.avg((F.col("prediction") == F.col("target")).cast("double")).alias("accuracy"))
    folds = _beside(sizes, hits, keys=parts)
    summary = folds.groupBy(*keys).agg(
        F.avg("accuracy").alias("avg_accuracy"), F.avg("baseline").alias("avg_baseline"),
        (F.avg("accuracy") - F.avg("baseline")).alias("improvement"),
    )
    weights = coefficients(models, features, parts).where(F.col("feature") != "intercept")
    importance = weights.groupBy(*keys, "feature").agg(F.avg("coefficient").alias("average_coefficient"))
    return {"folds": folds, "summary": summary, "importance": importance}


@null_safe
def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, keys, "left")


def ranked_importance(importance: DataFrame, keys: str | Sequence[str] = "ticker") -> DataFrame:
    """``place`` of each feature inside its series, the largest mean coefficient first. The window holds a series' features."""
    largest_first = Window.partitionBy(*as_keys(keys)).orderBy(F.desc("average_coefficient"))
    return importance.withColumn("place", F.rank().over(largest_first))


def best_by_series(results: DataFrame, keys: str | Sequence[str] = "ticker", score: str = "f1", order: str = "train_order") -> DataFrame:
    """Each series' row with the highest score; the model trained first wins a tie. One aggregate, no sort."""
    keys = as_keys(keys)
    whole = F.struct(*[c for c in results.columns if c not in keys])
    best = results.groupBy(*keys).agg(F.max_by(whole, F.struct(F.col(score), -F.col(order))).alias("_best"))
    return best.select(*keys, "_best.*")
