"""The benchmark tables seen as bars, headlines, entities, ticks and pages.

Every view covers whole tables and whole texts. The SQL text next to a view is the same view for a
SQL engine that has the tables registered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.session import TEXT_TASKS_CONF

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FIRST_DAY = "1995-01-01"
# Words that occur in the documents, with invented valences.
WORD_VALENCES = {"that": 1.5, "with": 2.0, "this": -1.0, "was": -1.5, "from": -2.5, "for": 0.5}
# Names looked for in the documents, with invented types.
GAZETTEER = {"the": "ORG", "of the": "ORG", "est": "GPE", "and": "PERSON", "der": "LOC", "que": "PRODUCT"}

BARS_SQL = """
select o_orderpriority as ticker, cast(o_orderdate as date) as date,
       min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high,
       min(o_totalprice) as low, max_by(o_totalprice, o_orderkey) as close, count(*) as volume
from orders group by 1, 2
"""
NEWS_SQL = """
select doc_id,
       case doc_id % 5 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM'
                       when 3 then '4-NOT SPECIFIED' else '5-LOW' end as ticker,
       cast(date '1995-01-01' + cast((cast(floor(doc_id / 5) as int) * 7) % 73 as int) as date) as date,
       text as headline, source
from documents
"""
LEXICON_SQL = "select * from (values " + ", ".join(
    f"('{t}', cast({v} as double))" for t, v in WORD_VALENCES.items()
) + ") as t(term, valence)"
ENTITIES_SQL = """
select l_orderkey as doc, p_brand as entity, p_type as entity_type,
       l_orderkey * 1000000 + l_partkey as row_id, cast(l_shipdate as date) as date
from lineitem join part on l_partkey = p_partkey
"""
TICKS_SQL = "select event_type as ticker, ts, event_id, value as price from events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as daily bars of five tickers; partial aggregation per task absorbs hot days."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")
    ).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def news_columns(doc_id: Column) -> tuple[Column, Column]:
    """Ticker and date given to a document."""
    ticker = F.get(F.array(*[F.lit(p) for p in PRIORITIES]), (doc_id % 5).cast("int"))
    day = (F.floor(doc_id / 5).cast("int") * 7) % 73
    return ticker, F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as headlines, whole texts."""
    ticker, day = news_columns(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", ticker.alias("ticker"), day.alias("date"), F.col("text").alias("headline"), "source"
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headlines for queries that work through every text.

    A file of one row group is read by one task. Where the session asks for it (``local_session`` does,
    a cluster need not), the rows are dealt out to that many tasks first.
    """
    tasks = spark.conf.get(TEXT_TASKS_CONF, None)
    return news(spark, sf_dir).repartition(int(tasks)) if tasks else news(spark, sf_dir)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WORD_VALENCES.items()), "term string, valence double")


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GAZETTEER.items()), "entity string, entity_type string")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as entity mentions: the order is the text, the brand the entity."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("doc"),
            F.col("p_brand").alias("entity"),
            F.col("p_type").alias("entity_type"),
            (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("row_id"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
