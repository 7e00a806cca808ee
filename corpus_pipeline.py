"""Training-data pipeline: quality, near-duplicates, repeated strings, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``docs`` has doc_id and text; of the
further columns of ``documents`` (lang, source, n_chars) missing ones are NULL, all others are dropped. ``run`` stores every
stage's rows in the shared folder and reads them back for the next.

All stages: a null text counts as an empty one, texts are read whole however long they are, an empty table gives an empty
result of the same columns, and clashing further columns are dropped before any work. What repeated rows, ties and rows
without an id become is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import newstape
from newstape.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from newstape.llm.warc import new_folder

cloudpickle.register_pickle_by_value(newstape)

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KINDS = ("long", "string", "string", "string", "long")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; missing ones are NULL, others are dropped."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in zip(COLUMNS, KINDS)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labelled ones among ``docs``.

    A document stays from a score of 0.5 on, the class threshold itself included (ties stay). Equal texts have equal
    scores: repeated rows stay or go together. An empty text has the score of features that are all zero. Rows without an
    id teach nothing and are judged like any other. Where nothing can be learned every document stays.
    """
    docs = _documents(docs)
    ranking = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, ranking)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Texts without words have one fingerprint and are one group. Rows that repeat an id belong to one document: they stay
    or go together. Rows without an id are linked by their text and stay only where no document of their group has an id.
    """
    return simhash.keep_one(_documents(docs))


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that documents of smaller ids hold.

    Characters that are cut in part go as well; documents of which nothing is left go, empty ones stay. Rows that repeat
    an id are one document's and cut nothing from each other; rows without an id come after all others.
    """
    return suffix_dedup.trimmed(_documents(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    An alignment that just reaches the threshold counts (ties go). Every row is judged by its own text, whatever its id:
    repeated rows stay or go together, empty texts stay. An empty benchmark removes nothing.
    """
    return decontaminate.clean_documents(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row, repeated ones and those without an id included.

    An empty text has no tokens and the digests of the empty text.
    """
    return bpe.digests(_documents(docs), bpe.public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_text_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Trained scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
