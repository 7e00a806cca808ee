"""Stored classifiers: the fitted stages and one row of metadata."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from newstape.operators.boosting import BoostedTrees
from newstape.operators.forest import Forest

#: Models of this package, by the name that stands in their metadata row.
OWN = {"boosted": BoostedTrees, "forest": Forest}


def save_model(model: PipelineModel | BoostedTrees | Forest, path: str, metadata: dict | None = None) -> str:
    """Write the fitted stages and a metadata row below ``path``, replacing what was there."""
    spark = SparkSession.active()
    kind = next((name for name, own in OWN.items() if isinstance(model, own)), None)
    if kind:
        model.save(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    row = [(json.dumps(metadata or {}), stamp, kind)]
    spark.createDataFrame(row, "metadata string, saved_at string, kind string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/metadata")
    return path


def load_model(path: str) -> tuple[PipelineModel | BoostedTrees | Forest, dict]:
    """(fitted stages, metadata)."""
    spark = SparkSession.active()
    row = spark.read.parquet(f"{path}/metadata").first()
    kind = OWN.get(row.asDict().get("kind"), PipelineModel)
    return kind.load(f"{path}/model"), json.loads(row.metadata)
