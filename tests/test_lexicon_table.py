"""The lexicon as a table: same scores as the list, by lookups that do not slow down with the hits of a text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from newstape.operators import sentiment

SCORES = ["sentiment_compound", "sentiment_positive", "sentiment_neutral", "sentiment_negative"]


def test_many_hits_in_long_texts(spark):
    """Four texts of 12,000 words, all different, all in the lexicon; a search through the hits takes 280 million steps."""
    n = 12_000
    words = [f"w{i}x" for i in range(n)]
    texts = []
    for seed in range(4):
        random.Random(seed).shuffle(words)
        texts.append((seed, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id int, cleaned_text string").coalesce(1)
    lexicon = spark.range(n).select(F.format_string("w%dx", "id").alias("term"), ((F.col("id") % 9 - 4) * 0.5).alias("valence"))
    sentiment.lexicon_score_table(df.limit(1), lexicon.limit(9), rules=False).collect()
    begun = time.time()
    rows = sentiment.lexicon_score_table(df, lexicon, rules=False).select("doc_id", *SCORES).collect()
    assert time.time() - begun < 12
    total = sum((i % 9 - 4) * 0.5 for i in range(n))
    assert {r.sentiment_compound for r in rows} == {round(total / (total * total + 15) ** 0.5, 4)} and len(rows) == 4


@pytest.mark.parametrize("rules", [True, False])
@pytest.mark.parametrize("match_phrases", [True, False])
def test_table_scores_like_the_list(spark, rules, match_phrases):
    terms = {"good": 2.0, "bad": -2.0, "not good": -3.0, "very": 1.0, "gut è": 1.5, "è": -1.0, "nan": 0.0}
    texts = ["good", "not good at all", "VERY good but bad !", "", "gut è", "bad bad good good very", "nan", "so not good", "no hit here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, cleaned_text string")
    lexicon = spark.createDataFrame(list(terms.items()), "term string, valence double")
    kw = {"rules": rules, "match_phrases": match_phrases, "empty_neutral": 1.0}
    a = sentiment.lexicon_score_table(df, lexicon, **kw).select("doc_id", *SCORES)
    b = sentiment.lexicon_score(df, terms, **kw).select("doc_id", *SCORES)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
