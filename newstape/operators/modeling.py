"""Up/down classifiers with time-ordered validation, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstape.operators.backtest import signal_confusion
from newstape.operators.blocks import as_keys, null_safe
from newstape.operators.boosting import BoostedTrees, fit_boosted_trees
from newstape.operators.forest import Forest, fit_forest
from newstape.operators.joins import join_sentiment
from newstape.operators.ordering import best_model, sort_importance, time_series_folds, time_split
from newstape.operators.series import FEATURES, create_features, label_next_move
from newstape.session import cut_lineage
from newstape.sources.models import save_model

# Feature candidates, used as far as the table has them (fixed values).
FEATURE_CANDIDATES = (
    "open", "high", "low", "close", "volume",
    "sma20", "sma50", "rsi14", "macd", "bb_upper", "bb_lower",
    "sentiment_score", "sentiment_positive", "sentiment_negative", "sentiment_neutral",
)
SEED = 42


def available_features(df: DataFrame, candidates: Sequence[str] = FEATURE_CANDIDATES) -> list[str]:
    return [c for c in candidates if c in df.columns]


@null_safe
def standardize(
    df: DataFrame,
    features: Sequence[str],
    keys: str | Sequence[str] = "ticker",
    fit_on: Column | None = None,
) -> DataFrame:
    """z-scores with the population deviation per ticker, replacing the columns.

    ``fit_on`` picks the rows the means come from (training rows); None takes all rows. A constant
    column is only centred.
    """
    keys = as_keys(keys)
    base = df if fit_on is None else df.where(fit_on)
    stats = base.groupBy(*keys).agg(
        *[a for c in features for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    )
    joined = df.join(stats, keys, "left")

    def scaled(c: str) -> Column:
        spread = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        return F.try_divide(F.col(c) - F.col(f"_m_{c}"), spread)

    out = joined.withColumns({c: scaled(c) for c in features})
    return out.drop(*[f"_{part}_{c}" for c in features for part in "ms"])


def prepare_data(
    bars: DataFrame,
    daily: DataFrame | None = None,
    target_shift: int = 1,
    test_size: float = 0.2,
    fit_scope: str = "train",
    keys: str | Sequence[str] = "ticker",
) -> tuple[DataFrame, list[str]]:
    """Label, join, fill, drop incomplete rows, split by time and scale.

    Rows are dropped for missing features or target only. The unscaled close stays as ``price``.
    ``fit_scope='all'`` scales with test rows included. The daily table is written once, as the split and the scales
    read the joined rows several times, each time down to the texts.
    """
    labelled = label_next_move(bars, target_shift, keys=keys)
    joined = join_sentiment(labelled, cut_lineage(daily), keys) if daily is not None else labelled
    features = available_features(joined)
    complete = joined.na.drop(subset=[*features, "price_change"]).withColumn("price", F.col("close"))
    split = time_split(complete, test_size, keys)
    fit_on = F.col("role") == "train" if fit_scope == "train" else None
    return standardize(split, features, keys, fit_on), features


def _pipeline(classifier, features: Sequence[str]) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    classifier.setFeaturesCol("features").setLabelCol("target").setPredictionCol("prediction")
    return Pipeline(stages=[assembler, classifier])


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """``weight`` = n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes")).withColumn("_one", F.lit(1))
    weights = counts.withColumn("_one", F.lit(1)).join(total, "_one")
    weights = weights.select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def train_logistic_regression(
    train: DataFrame,
    features: Sequence[str],
    c: float = 1.0,
    max_iter: int = 1000,
    balanced: bool = False,
) -> PipelineModel:
    """L2 penalty of strength 1/C on the summed loss, features taken as scaled."""
    rows = train.count()
    classifier = LogisticRegression(
        regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    if balanced:
        train = balanced_weights(train)
        classifier.setWeightCol("weight")
    return _pipeline(classifier, features).fit(train)


def train_random_forest(train: DataFrame, features: Sequence[str], trees: int = 100, seed: int = SEED, **more) -> Forest:
    """Trees of unlimited depth with exact splits."""
    return fit_forest(train, features, trees=trees, seed=seed, **more)


def train_boosted_trees(
    train: DataFrame, features: Sequence[str], rounds: int = 100, max_depth: int = 3, rate: float = 0.1, **more
) -> BoostedTrees:
    """Second-order boosting with regularised leaves."""
    return fit_boosted_trees(train, features, rounds=rounds, max_depth=max_depth, rate=rate, **more)


TRAINERS = {
    "logistic_regression": train_logistic_regression,
    "random_forest": train_random_forest,
    "boosted_trees": train_boosted_trees,
}


def predict(model: PipelineModel | BoostedTrees | Forest, df: DataFrame) -> DataFrame:
    """Class and probability of class 1; every input column stays on its row."""
    if isinstance(model, BoostedTrees | Forest):
        return model.predict(df)
    scored = model.transform(df)
    return scored.withColumns(
        {
            "probability": vector_to_array("probability")[1],
            "prediction": F.col("prediction").cast("int"),
        }
    ).drop("features", "rawPrediction")


def evaluate_predictions(
    predictions: DataFrame, model_name: str = "model", keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 and the 2x2 confusion matrix."""
    quality = signal_confusion(predictions, "prediction", "target", list(keys))
    return quality.select(
        *keys,
        F.lit(model_name).alias("model_name"),
        "accuracy",
        "precision",
        "recall",
        F.col("f1_score").alias("f1"),
        F.array(
            F.array("true_negatives", "false_positives"), F.array("false_negatives", "true_positives")
        ).alias("confusion_matrix"),
    )


def evaluate_model(model: PipelineModel | BoostedTrees | Forest, test: DataFrame, model_name: str = "model") -> DataFrame:
    return evaluate_predictions(predict(model, test), model_name)


def class_report(df: DataFrame, label: str = "target", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class."""
    pairs = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("_n"))
    true = pairs.groupBy(F.col(label).alias("class")).agg(
        F.sum("_n").alias("support"),
        F.sum(F.when(F.col(label) == F.col(predicted), F.col("_n")).otherwise(0)).alias("_hits"),
    )
    said = pairs.groupBy(F.col(predicted).alias("class")).agg(F.sum("_n").alias("_said"))
    merged = true.join(said, "class", "full_outer").na.fill(0)
    precision = F.coalesce(F.try_divide("_hits", "_said"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("_hits", "support"), F.lit(0.0))
    rated = merged.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        F.lit(0.0),
    )
    return rated.select("class", "precision", "recall", f1.alias("f1"), "support")


def enough_classes(train: DataFrame, least: int = 2) -> bool:
    """Both classes present with ``least`` rows or more (one aggregate row is read)."""
    row = train.agg(
        F.count_if(F.col("target") == 1).alias("ups"), F.count_if(F.col("target") == 0).alias("downs")
    ).first()
    return min(row.ups, row.downs) >= least


def compare_models(
    bars: DataFrame,
    daily: DataFrame | None = None,
    test_size: float = 0.2,
    fit_scope: str = "train",
    model_path: str | None = None,
    trainers: dict | None = None,
    keys: str | Sequence[str] = "ticker",
) -> dict:
    """Train every model on the same rows and pick the best F1 (first trained on ties).

    Returns ``results`` (one row per model), ``best_model``, ``models``, ``features``, ``warning``
    and the prepared rows. The prepared table is written once, as every model reads it repeatedly.
    """
    prepared, features = prepare_data(bars, daily, 1, test_size, fit_scope, keys)
    prepared = cut_lineage(prepared)
    train, test = prepared.where("role = 'train'"), prepared.where("role = 'test'")
    warning = None if enough_classes(train) else "a class has fewer than two training rows"
    chosen = trainers or TRAINERS
    models = {name: fit(train, features) for name, fit in chosen.items()}
    rows = [
        evaluate_model(model, test, name).withColumn("train_order", F.lit(i))
        for i, (name, model) in enumerate(models.items())
    ]
    rated = reduce(DataFrame.unionByName, rows)
    # One row per model: collected once, so that no model scores its rows twice.
    results = prepared.sparkSession.createDataFrame(rated.collect(), rated.schema)
    best = best_model(results).first()
    if model_path:
        metadata = {
            "features": features,
            "model_name": best.model_name,
            "train_samples": train.count(),
            "test_samples": test.count(),
            "metrics": {k: best[k] for k in ("accuracy", "precision", "recall", "f1")},
        }
        save_model(models[best.model_name], model_path, metadata)
    return {
        "results": results,
        "best_model": best.model_name,
        "models": models,
        "features": features,
        "prepared": prepared,
        "warning": warning,
    }


def cross_validate(
    bars: DataFrame,
    daily: DataFrame,
    least_rows: int = 50,
    least_train: int = 30,
    keys: str | Sequence[str] = "ticker",
    folds: int | None = None,
    fit_scope: str = "all",
) -> dict[str, DataFrame] | None:
    """Expanding-window validation of a balanced logistic regression.

    ``fit_scope='all'`` scales once, with the test folds included; ``'train'`` scales every fold by
    its training rows.

    Returns ``folds`` (accuracy and baseline per fold), ``summary`` and ``importance`` (mean
    coefficient per feature), or None below ``least_rows`` rows. The loop runs over at most five
    folds; each fit is a Spark job over all tickers.
    """
    features = list(FEATURES)
    # Features number the joined rows in several branches; without the cut each would score the texts.
    rows = create_features(join_sentiment(bars, cut_lineage(daily), keys), label=True, keys=keys)
    complete = rows.na.drop(subset=[*features, "target"])
    scaled = standardize(complete, features, keys) if fit_scope == "all" else complete
    prepared = cut_lineage(scaled)
    if prepared.count() < least_rows:
        return None
    spark = bars.sparkSession
    long = time_series_folds(prepared, folds, keys)
    if fit_scope == "train":
        long = cut_lineage(standardize(long, features, [*as_keys(keys), "fold"], F.col("role") == "train"))
    sizes = (
        long.groupBy("fold")
        .agg(
            F.count_if(F.col("role") == "train").alias("train_rows"),
            F.count_if((F.col("role") == "train") & (F.col("target") == 1)).alias("train_ups"),
            F.count_if(F.col("role") == "test").alias("test_rows"),
            F.count_if((F.col("role") == "test") & (F.col("target") == 1)).alias("test_ups"),
        )
        .orderBy("fold")
        .collect()  # one row per fold, five at most
    )
    fold_rows, weights = [], []
    for size in sizes:
        majority = 1 if size.train_ups > size.train_rows - size.train_ups else 0
        agree = size.test_ups if majority == 1 else size.test_rows - size.test_ups
        baseline = agree / size.test_rows if size.test_rows else 0.0
        usable = 0 < size.train_ups < size.train_rows and size.train_rows >= least_train
        accuracy = None
        if usable:
            fold = long.where(F.col("fold") == size.fold)
            model = train_logistic_regression(fold.where("role = 'train'"), features, balanced=True)
            quality = evaluate_model(model, fold.where("role = 'test'")).first()
            accuracy = float(quality.accuracy)
            weights += [(f, float(w)) for f, w in zip(features, model.stages[-1].coefficients.toArray())]
        fold_rows.append((size.fold, size.train_rows, size.test_rows, majority, baseline, accuracy))
    per_fold = spark.createDataFrame(
        fold_rows,
        "fold bigint, train_rows bigint, test_rows bigint, majority_class int, baseline double, accuracy double",
    )
    summary = per_fold.agg(
        F.avg("accuracy").alias("avg_accuracy"),
        F.avg("baseline").alias("avg_baseline"),
        (F.avg("accuracy") - F.avg("baseline")).alias("improvement"),
    )
    coefficients = spark.createDataFrame(weights, "feature string, coefficient double")
    return {"folds": per_fold, "summary": summary, "importance": sort_importance(coefficients)}
