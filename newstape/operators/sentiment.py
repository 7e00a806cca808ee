"""Headline scoring and topics."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstape.functions.lexicon import FINANCE_TERMS, STOP_WORDS
from newstape.functions.scoring import let, lookup_in, score_expr
from newstape.functions.text import clean_text, clean_text_light, plain_words, sentiment_category, words_of
from newstape.schema import ENTITY_TEXT_COLUMNS, TEXT_COLUMNS, pick_column

def _spread(df: DataFrame, scores: Column) -> DataFrame:
    return (
        df.withColumn("_scores", scores)
        .withColumns(
            {
                "sentiment_compound": F.col("_scores.compound"),
                "sentiment_positive": F.col("_scores.pos"),
                "sentiment_neutral": F.col("_scores.neu"),
                "sentiment_negative": F.col("_scores.neg"),
                "sentiment_category": sentiment_category("_scores.compound"),
            }
        )
        .drop("_scores")
    )


def normalized_terms(terms: dict[str, float]) -> dict[str, float]:
    """Lower-case terms, one valence each: of terms that only differ in case the strongest counts, the
    positive one if two are equally strong."""
    out: dict[str, float] = {}
    for term, valence in terms.items():
        low, value = term.lower(), float(valence)
        if low not in out or (abs(value), value) > (abs(out[low]), out[low]):
            out[low] = value
    return out


def normalized_lexicon(lexicon: DataFrame) -> DataFrame:
    """The same rule for a table (``term, valence``); rows with a NULL are left out."""
    known = lexicon.where(F.col("term").isNotNull() & F.col("valence").isNotNull())
    per_term = known.groupBy(F.lower("term").alias("term")).agg(
        F.max(F.col("valence").cast("double")).alias("_high"), F.min(F.col("valence").cast("double")).alias("_low")
    )
    return per_term.select("term", F.when(F.col("_high") >= -F.col("_low"), F.col("_high")).otherwise(F.col("_low")).alias("valence"))


@lru_cache(maxsize=32)
def _inline_scores(
    text: str,
    terms: tuple[tuple[str, float], ...],
    rules: bool,
    empty_neutral: float,
    match_phrases: bool,
    lower_case: bool,
) -> Column:
    """The scoring expression. It is a plain tree over a column name, so it is built once per word
    list: that takes some hundred calls into the JVM."""
    pairs = {t: v for t, v in terms if " " in t} if match_phrases else {}
    phrases = lookup_in(pairs) if pairs else None
    return score_expr(F.col(text), lookup_in(dict(terms)), rules, empty_neutral, phrases, lower_case)


def lexicon_score(
    df: DataFrame,
    lexicon: dict[str, float],
    text: str = "cleaned_text",
    rules: bool = True,
    empty_neutral: float = 0.0,
    match_phrases: bool = False,
    lower_case: bool = False,
) -> DataFrame:
    """Score a cleaned text column with a word list. No shuffle, no Python, safe in streams.

    The list becomes part of the plan, whatever its length. ``lexicon_score_table`` gives the same
    scores for a lexicon that is a table.
    """
    terms = tuple(normalized_terms(lexicon).items())
    return _spread(df, _inline_scores(text, terms, rules, empty_neutral, match_phrases, lower_case))


#: Words of texts that a task holds as Python values at a time.
WORDS_AT_ONCE = 100_000


def _valences(match_phrases: bool) -> Callable[..., Column]:
    """Valences of all words of a row and of the pairs that they begin, from the row's own lexicon hits.

    A map column is searched from its start at every lookup, so a text with many different hits would cost their
    number times its words; here each row has a hash table.
    """
    empty = pa.array([], pa.list_(pa.float64()))

    @F.arrow_udf("struct<words: array<double>, pairs: array<double>>")
    def look(words: pa.Array, terms: pa.Array, valences: pa.Array) -> pa.Array:
        words, terms = (c.cast(pa.list_(pa.binary())) for c in (words, terms))
        held = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)) // WORDS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(words)]
        singles, doubles = [empty], [empty]
        for a, b in zip(cuts, cuts[1:]):
            one, two = [], []
            for said, hits, values in zip(*(c.slice(a, b - a).to_pylist() for c in (words, terms, valences))):
                known = dict(zip(hits, values))
                one.append(None if said is None else [known.get(w) for w in said])
                # The last word makes no pair.
                two.append([known.get(w + b" " + v) for w, v in zip(said, said[1:])] if said and match_phrases else None)
            singles.append(pa.array(one, pa.list_(pa.float64())))
            doubles.append(pa.array(two, pa.list_(pa.float64())))
        return pa.StructArray.from_arrays([pa.concat_arrays(singles), pa.concat_arrays(doubles)], ["words", "pairs"])

    return look


def lexicon_score_table(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "cleaned_text",
    rules: bool = True,
    empty_neutral: float = 0.0,
    match_phrases: bool = False,
    lower_case: bool = False,
) -> DataFrame:
    """Same scores with the lexicon as a table of any size (``term, valence``), by one plan.

    The texts are read once. Each row sends its distinct words (and word pairs, for phrases) to a
    join with the lexicon, and itself along as one more element that no term matches; only hits and
    the rows themselves are grouped again, and each row looks its words up among its own hits. No broadcast is forced: Spark decides by size.
    """
    def candidates(lows: Column) -> Column:
        if not match_phrases:
            return F.array_distinct(lows)
        pairs = F.transform(lows, lambda w, i: F.concat_ws(" ", w, F.get(lows, i + 1)))
        return F.array_distinct(F.concat(lows, pairs))

    whole = F.struct(*df.columns)
    numbered = df.select(F.monotonically_increasing_id().alias("_row"), whole.alias("_whole"), F.transform(words_of(text), F.lower).alias("_lows"))
    nothing = F.lit(None).cast(numbered.schema["_whole"].dataType)
    own = F.struct(F.concat(F.lit("\0"), F.col("_row").cast("string")).alias("term"), F.col("_whole").alias("_whole"))
    words = let(F.col("_lows"), lambda lows: F.transform(candidates(lows), lambda w: F.struct(w.alias("term"), nothing.alias("_whole"))))
    spread = numbered.select("_row", F.inline(F.concat(F.array(own), words)))
    met = spread.join(normalized_lexicon(lexicon), "term", "left")
    met = met.where(F.col("valence").isNotNull() | F.col("_whole").isNotNull())
    hit = F.when(F.col("valence").isNotNull(), F.struct("term", "valence"))
    grouped = met.groupBy("_row").agg(F.first("_whole", ignorenulls=True).alias("_whole"), F.collect_list(hit).alias("_hits"))
    rows = grouped.select("_whole.*", F.col("_hits.term").alias("_terms"), F.col("_hits.valence").alias("_valences"))
    rows = rows.withColumn("_known", _valences(match_phrases)(F.transform(words_of(text), F.lower), "_terms", "_valences"))
    pairs = F.col("_known.pairs") if match_phrases else None
    scores = score_expr(F.col(text), None, rules, empty_neutral, None, lower_case, F.col("_known.words"), pairs)
    return _spread(rows, scores).drop("_terms", "_valences", "_known")


def score_news(
    df: DataFrame,
    lexicon: dict[str, float] | None = None,
    finance: bool = True,
    text: str | None = "headline",
    rules: bool = True,
    match_phrases: bool = False,
) -> DataFrame:
    """Clean strictly, score, classify. ``finance`` lays the finance terms over the lexicon.

    A text without words scores neutral 1.0 on the standard path and 0.0 on the finance path.
    """
    column = pick_column(df, TEXT_COLUMNS, text)
    terms = {**(lexicon or {}), **(FINANCE_TERMS if finance else {})}
    cleaned = df.withColumn("cleaned_text", clean_text(column))
    return lexicon_score(
        cleaned,
        terms,
        rules=rules,
        empty_neutral=0.0 if finance else 1.0,
        match_phrases=match_phrases,
        lower_case=True,
    )


def score_news_light(df: DataFrame, lexicon: dict[str, float], text: str = "headline") -> DataFrame:
    """Clean lightly (case and symbols stay, so every rule can apply), score, classify."""
    return lexicon_score(df.withColumn("cleaned_text", clean_text_light(text)), lexicon)


def category_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows and mean compound score per category."""
    return df.groupBy(*(keys or []), "sentiment_category").agg(
        F.count(F.lit(1)).alias("headlines"), F.avg("sentiment_compound").alias("avg_compound")
    )


def _place(df: DataFrame, key: str) -> Column:
    """Order of a word in the corpus: row key, then position. Packed into one number for number
    keys, so that the aggregation keeps it in its hash table; a struct would make it sort."""
    if isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        step = F.lit(2**31).cast("decimal(10,0)")  # more than any array position
        return F.col(key).cast("decimal(20,0)") * step + F.col("_pos")
    return F.struct(key, "_pos")


def word_counts(df: DataFrame, key: str, text: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Count and first place of every topic word: three or more of a-z, not a stop word.

    Counts are partially aggregated per task, so a frequent word is no hot key.
    """
    by = by or []
    column = pick_column(df, ENTITY_TEXT_COLUMNS, text)
    words = df.select(*by, key, F.posexplode(plain_words(column)).alias("_pos", "word"))
    topical = words.where(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(*STOP_WORDS))
    return topical.groupBy(*by, "word").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(_place(df, key)).alias("first_seen")
    )


def extract_topics(df: DataFrame, n: int = 5, key: str = "doc_id", text: str | None = None) -> DataFrame:
    """The n most frequent topic words; equal counts go by first place."""
    counts = word_counts(df, key, text)
    return (
        counts.orderBy(F.desc("occurrences"), F.asc("first_seen")).limit(n).select("word", "occurrences")
    )


def extract_topics_by(
    df: DataFrame, by: list[str], n: int = 5, key: str = "doc_id", text: str | None = None
) -> DataFrame:
    """Top n words per group; the rank limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("occurrences"), F.asc("first_seen")))
    return (
        word_counts(df, key, text, by)
        .withColumn("rank", rank)
        .where(F.col("rank") <= n)
        .select(*by, "word", "occurrences", "rank")
    )
