"""Entities of texts: names from a gazetteer, amounts, percentages and dates from patterns, or a
model of the caller's choice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstape.functions.text import clean_text_light
from newstape.operators.gazetteer import AUTOMATON_NAMES, hits, small_gazetteer, word_form
from newstape.schema import ENTITY_TEXT_COLUMNS, pick_column

# Entity types that are kept (fixed values).
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "DATE", "MONEY", "PERCENT")

_MONTHS = (
    "(?:January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug"
    "|September|Sept|Sep|October|Oct|November|Nov|December|Dec)"
)
# Own patterns, written so that Java and RE2 agree on them.
PATTERNS = {
    "MONEY": r"[$€£][0-9][0-9,]*(?:\.[0-9]+)?(?: (?:thousand|million|billion|trillion))?",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)? ?(?:%|percent)",
    "DATE": rf"{_MONTHS}\.? [0-9]{{1,2}}(?:, [0-9]{{4}})?|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}",
}

# Characters that each kind can begin with: one look at a place of the text spares most places the pattern's alternatives.
BEGINNINGS = {"MONEY": "[$€£]", "PERCENT": "[0-9]", "DATE": "[JFMASOND0-9]"}

Model = Callable[[str], Iterable[tuple[str, str]]]
_HIT = "entity: string, entity_type: string, _order: int"
SHAPE = "entity string, entity_type string, _order int"


def _finish(found: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """One row per distinct entity of a text; the label found last wins. The ``keep`` columns belong
    to the text, so grouping by them as well changes nothing and saves a join."""
    return (
        found.where((F.length("entity") >= 2) & F.col("entity_type").isin(*ENTITY_TYPES))
        .groupBy(key, *keep, "entity")
        .agg(F.max(F.struct("_order", "entity_type"))["entity_type"].alias("entity_type"))
    )


def _pattern_matches(squeezed: Column) -> Column:
    """All pattern hits of a squeezed text as one array of (entity, entity_type, _order)."""

    def matches(i: int, kind: str, pattern: str) -> Column:
        def row(e: Column) -> Column:
            return F.struct(e.alias("entity"), F.lit(kind).alias("entity_type"), F.lit(i).alias("_order"))

        looked = f"(?={BEGINNINGS[kind]})(?:{pattern})"
        return F.transform(F.regexp_extract_all(squeezed, F.lit(looked), F.lit(0)), row)

    return F.array_distinct(F.concat(*[matches(i, kind, p) for i, (kind, p) in enumerate(PATTERNS.items())]))


def pattern_entities(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    cleaned = df.select(*ids, clean_text_light(text).alias("_text"))
    return cleaned.select(*ids, F.inline(_pattern_matches(F.col("_text"))))


def gazetteer_entities(
    df: DataFrame,
    gazetteer: DataFrame,
    ids: list[str],
    text: str,
    patterns: bool = False,
    most: int = AUTOMATON_NAMES,
) -> DataFrame:
    """Gazetteer names (``entity, entity_type``) that occur in the text as runs of whole words, of any
    length; with ``patterns`` the pattern hits as well, from the same reading of the texts.

    Names and texts are compared in word form, so marks inside and around names do not matter, and
    nested and overlapping names are all found; names without a word never match. Up to ``most`` names
    make an automaton that reads each text once, more are joined with the texts' first words; both ways
    find the same.
    """
    names = small_gazetteer(gazetteer, most)
    if names is None:
        return _joined_entities(df, gazetteer, ids, text, patterns)
    read = df.select(*ids, _own_patterns(text, patterns).alias("_found"), word_form(text).alias("_form"))
    named = hits(read, names)
    order = F.lit(len(PATTERNS))
    there = F.transform("_names", lambda e: F.struct(e["entity"].alias("entity"), e["entity_type"].alias("entity_type"), order.alias("_order")))
    both = F.concat(F.coalesce("_found", F.array().cast(f"array<struct<{_HIT}>>")), there.cast(f"array<struct<{_HIT}>>"))
    return named.select(*ids, F.inline(both))


def _own_patterns(text: str, patterns: bool) -> Column:
    return (_pattern_matches(clean_text_light(text)) if patterns else F.lit(None)).cast(f"array<struct<{_HIT}>>")


def _joined_entities(df: DataFrame, gazetteer: DataFrame, ids: list[str], text: str, patterns: bool) -> DataFrame:
    """Names of a large gazetteer, looked for by their first two words (or the only one).

    Each text sends its distinct words and word pairs to an equality join with the names, and itself
    along as one more element that no name matches; names that share the words are then compared with the
    whole text. Spark may split hot words.
    """
    numbered = df.select(
        F.monotonically_increasing_id().alias("_row"),
        *ids,
        _own_patterns(text, patterns).alias("_found"),
        F.filter(F.split(word_form(text), " "), lambda w: w != "").alias("_words"),
    )
    numbered = numbered.select(
        "_row",
        "_words",
        F.struct(*ids, "_found", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_plain")).alias("_whole"),
    )
    nothing = F.lit(None).cast(numbered.schema["_whole"].dataType)
    own = F.struct(F.concat(F.lit("\0"), F.col("_row").cast("string")).alias("_head"), F.col("_whole").alias("_whole"))
    pairs = F.transform("_words", lambda w, i: F.concat_ws(" ", w, F.get("_words", i + 1)))
    heads = F.transform(F.array_distinct(F.concat("_words", pairs)), lambda w: F.struct(w.alias("_head"), nothing.alias("_whole")))
    spread = numbered.select("_row", F.inline(F.concat(F.array(own), heads)))
    formed = gazetteer.where("entity is not null").select("entity", "entity_type", word_form("entity").alias("_form")).where("_form <> ''")
    names = formed.withColumn("_head", F.array_join(F.slice(F.split("_form", " "), 1, 2), " "))
    met = spread.join(names, "_head", "left").where(F.col("entity").isNotNull() | F.col("_whole").isNotNull())
    hit = F.when(F.col("entity").isNotNull(), F.struct("entity", "entity_type", F.lit(len(PATTERNS)).alias("_order"), "_form"))
    grouped = met.groupBy("_row").agg(F.first("_whole", ignorenulls=True).alias("_whole"), F.collect_list(hit).alias("_names"))
    rows = grouped.select("_whole.*", "_names")
    there = F.filter("_names", lambda e: F.contains(F.col("_plain"), F.concat(F.lit(" "), e["_form"], F.lit(" "))))
    plain = F.transform(there, lambda e: F.struct(e["entity"].alias("entity"), e["entity_type"].alias("entity_type"), e["_order"].alias("_order")))
    both = F.concat(F.coalesce("_found", F.array().cast(f"array<struct<{_HIT}>>")), plain.cast(f"array<struct<{_HIT}>>"))
    return rows.select(*ids, F.inline(both))


def model_entities(df: DataFrame, load_model: Callable[[], Model], ids: list[str], text: str) -> DataFrame:
    """Entities from a model: ``load_model`` runs once per task, the model once per text, or its ``many`` (texts to lists
    of entities, in their order) once per batch if it has that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            batch = batch[batch[text].astype(bool)]
            read = model.many(batch[text]) if hasattr(model, "many") else map(model, batch[text])
            rows = [
                (*own, entity, kind, i)
                for own, found in zip(batch[ids].itertuples(index=False, name=None), read)
                for i, (entity, kind) in enumerate(found)
            ]
            yield pd.DataFrame(rows, columns=[*ids, "entity", "entity_type", "_order"])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    return df.select(*ids, text).mapInPandas(run, f"{kept}, {SHAPE}")


def extract_entities(
    df: DataFrame,
    key: str = "doc_id",
    text: str | None = "headline",
    gazetteer: DataFrame | None = None,
    load_model: Callable[[], Model] | None = None,
    keep: tuple[str, ...] = ("date",),
) -> DataFrame:
    """``key, entity, entity_type`` plus the ``keep`` columns of the text's row. Whole texts are read."""
    column = pick_column(df, ENTITY_TEXT_COLUMNS, text)
    kept = [c for c in keep if c in df.columns]
    ids = [key, *kept]
    texts = df.where(F.col(column).isNotNull())
    if load_model is not None:
        found = model_entities(texts, load_model, ids, column)
    elif gazetteer is not None:
        found = gazetteer_entities(texts, gazetteer, ids, column, patterns=True)
    else:
        found = pattern_entities(texts, ids, column)
    return _finish(found, key, kept)


def entity_type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("occurrences"))


def top_entities(entities: DataFrame, entity_type: str, n: int = 5, row_id: str = "row_id") -> DataFrame:
    """Most frequent entities of one type; equal counts go by first appearance."""
    counted = (
        entities.where(F.col("entity_type") == entity_type)
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min(row_id).alias("_first"))
    )
    return counted.orderBy(F.desc("occurrences"), F.asc("_first"), F.asc("entity")).limit(n).drop("_first")
