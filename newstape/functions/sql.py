"""SQL names for callers who write queries as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SPACE = r"[\\s\\x1c-\\x1f]"


def register(spark: SparkSession) -> None:
    """Create ``clean_text``, ``clean_text_light`` and ``sentiment_category`` as SQL functions.

    They are plain SQL expressions, so Catalyst inlines them.
    """
    spark.sql(
        f"""
        create or replace temporary function clean_text(body string) returns string return
        trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(body, '')),
            '(?U)(http|www)[^\\\\s\\\\x1c-\\\\x1f]+', ''),
            '(?U)[^a-zA-Z0-9\\\\s\\\\x1c-\\\\x1f.,!?-]', ''),
            '(?U){_SPACE}+', ' '))
        """
    )
    spark.sql(
        f"""
        create or replace temporary function clean_text_light(body string) returns string return
        trim(regexp_replace(coalesce(body, ''), '(?U){_SPACE}+', ' '))
        """
    )
    spark.sql(
        """
        create or replace temporary function sentiment_category(score double) returns string return
        case when score >= 0.05 then 'Positive' when score <= -0.05 then 'Negative' else 'Neutral' end
        """
    )
