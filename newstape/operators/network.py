"""Entity co-occurrence network."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstape.operators.joins import entities_in_range

# Distinct entities of a slice of a text; larger texts are split, and two slices at most meet in one list.
PAIR_SLICE = 256


class Network(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    status: DataFrame


def entity_counts(entities: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows per entity with the type of its first row (smallest type among rows of one id).

    Rows are counted per (entity, type) first, with plain numbers in the hash table.
    """
    per_type = (
        entities.where(F.col("entity").isNotNull())
        .groupBy("entity", "entity_type")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(row_id).alias("_at"))
    )
    return (
        per_type.groupBy("entity")
        .agg(F.sum("_n").alias("size"), F.min(F.struct("_at", "entity_type")).alias("first_seen"))
        .select("entity", "size", F.col("first_seen.entity_type").alias("entity_type"), "first_seen")
    )


def effective_threshold(counts: DataFrame, requested: int, enough: int = 5) -> DataFrame:
    """One row: the requested threshold, lowered until ``enough`` entities reach it, 1 at least.

    That is the fifth-largest count where it is smaller; only a top-5 list is looked at.
    """
    top = counts.select("size").orderBy(F.desc("size")).limit(enough)
    seen = top.agg(F.count(F.lit(1)).alias("_n"), F.min("size").alias("_fifth"))
    lowered = F.when(F.col("_n") < enough, F.lit(1)).otherwise(F.col("_fifth"))
    value = F.greatest(F.lit(1), F.least(F.lit(requested), lowered)) if requested > 1 else F.lit(requested)
    return seen.select(value.cast("bigint").alias("threshold"))


def frequent(counts: DataFrame, requested: int) -> DataFrame:
    """Entities that reach the effective threshold (joined on a constant: the other side is one row)."""
    threshold = effective_threshold(counts, requested).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(threshold), "_one")
        .where(F.col("size") >= F.col("threshold"))
        .drop("_one", "threshold")
    )


def entity_nodes(counts: DataFrame, requested: int, top: int = 50) -> DataFrame:
    """The most frequent qualifying entities with size and type."""
    return (
        frequent(counts, requested)
        .orderBy(F.desc("size"), F.asc("first_seen"))
        .limit(top)
        .select("entity", "size", "entity_type")
    )


def entity_edges(
    entities: DataFrame, allowed: DataFrame, text: str = "doc", pair_slice: int = PAIR_SLICE
) -> DataFrame:
    """Weight of each unordered pair: pairs of rows of the same text, summed over texts.

    Rows are first counted per (text, entity), so repeated rows never meet each other: a pair of
    different entities weighs the product of its counts, an entity with itself c(c-1)/2. The entities of
    a text meet as one list; those of a text with more than ``pair_slice`` are dealt out to slices by
    their hash, and each two slices meet on their own, so no list and no task holds a whole large text.
    Counting, listing and pairing are stages of their own, so a task holds the rows of one step only.
    """
    per_text = (
        entities.where(F.col(text).isNotNull())
        .join(allowed.select("entity"), "entity", "left_semi")
        .groupBy(text, "entity")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Shuffled by more than the text, else Spark drops the shuffle: a stage of its own, which tells how few texts are large.
    large = (
        per_text.groupBy(text)
        .agg(F.count(F.lit(1)).alias("_d"))
        .where(F.col("_d") > pair_slice)
        .select(text, F.ceil(F.col("_d") / F.lit(pair_slice)).alias("_slices"))
        .repartition(text, "_slices")
    )
    sliced = per_text.join(large, text, "left").withColumn("_slices", F.coalesce("_slices", F.lit(1)))
    dealt = sliced.select(
        text,
        F.pmod(F.xxhash64("entity"), F.col("_slices")).alias("_slice"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1)).alias("_other"),
        "entity",
        "c",
    )
    low, high = F.least("_slice", "_other"), F.greatest("_slice", "_other")
    met = dealt.withColumns({"_low": low, "_high": high}).drop("_other").repartition(text, "_low", "_high")
    lists = met.groupBy(text, "_low", "_high").agg(F.collect_list(F.struct("entity", "c", "_slice")).alias("_list"))
    own = F.col("_low") == F.col("_high")
    left = lists.select(own.alias("_own"), "_list", F.inline("_list").alias("entity1", "c1", "_slice1"))
    both = left.select("_own", "entity1", "c1", "_slice1", F.inline("_list").alias("entity2", "c2", "_slice2"))
    pair = (F.col("entity1") < F.col("entity2")) & (F.col("_own") | (F.col("_slice1") != F.col("_slice2")))
    loop = (F.col("entity1") == F.col("entity2")) & F.col("_own") & (F.col("c1") > 1)
    weight = F.when(F.col("entity1") == F.col("entity2"), F.expr("c1 * (c1 - 1) div 2")).otherwise(F.col("c1") * F.col("c2"))
    return both.where(pair | loop).groupBy("entity1", "entity2").agg(F.sum(weight).alias("weight"))


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends that are not among the listed nodes: size 1, type MISC."""
    ends = edges.select(F.explode(F.array("entity1", "entity2")).alias("entity")).distinct()
    return ends.join(nodes.select("entity"), "entity", "left_anti").select(
        "entity", F.lit(1).cast("bigint").alias("size"), F.lit("MISC").alias("entity_type")
    )


def network_status(counts: DataFrame, requested: int, least: int = 2) -> DataFrame:
    """Number of qualifying entities and whether they make a network."""
    found = frequent(counts, requested).agg(F.count(F.lit(1)).alias("entities"))
    return found.withColumn(
        "status", F.when(F.col("entities") < least, "not enough entities").otherwise("ok")
    )


def entity_network(
    entities: DataFrame,
    min_occurrences: int = 2,
    text: str = "doc",
    top: int = 50,
    strict_top_n: bool = False,
    row_id: str = "row_id",
) -> Network:
    """Nodes, edges and a status row.

    With fewer than two qualifying entities both tables are empty. ``strict_top_n`` keeps only edges
    between listed nodes; otherwise their other ends join the nodes with size 1.
    """
    counts = entity_counts(entities, row_id)
    status = network_status(counts, min_occurrences)
    enough = F.broadcast(status.where(F.col("status") == "ok").select(F.lit(1).alias("_one")))

    def if_enough(df: DataFrame) -> DataFrame:
        return df.withColumn("_one", F.lit(1)).join(enough, "_one", "left_semi").drop("_one")

    nodes = if_enough(entity_nodes(counts, min_occurrences, top))
    if strict_top_n:
        edges = entity_edges(entities, nodes, text)
    else:
        edges = if_enough(entity_edges(entities, frequent(counts, min_occurrences), text))
        nodes = nodes.unionByName(implicit_nodes(edges, nodes))
    return Network(nodes, edges, status)


def network_in_range(
    entities: DataFrame,
    news: DataFrame | None,
    in_range: Column,
    min_occurrences: int = 2,
    link: str = "source_text",
    **kw,
) -> Network:
    """Network of the texts in a date range; of all texts when the link column is missing."""
    linked = news is not None and link in entities.columns and link in news.columns
    kept = entities_in_range(entities, news, in_range, link) if linked else entities
    return entity_network(kept, min_occurrences, **kw)


def max_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max("weight"), F.lit(1)).alias("max_weight"))


def type_legend(nodes: DataFrame) -> DataFrame:
    return nodes.select("entity_type").distinct()
