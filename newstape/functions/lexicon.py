"""Word lists of the headline scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Valence of finance terms.
FINANCE_TERMS = {
    "bullish": 3.0,
    "outperform": 2.0,
    "beat": 2.0,
    "beats": 2.0,
    "exceeded": 1.5,
    "exceeds": 1.5,
    "upgrade": 1.5,
    "upgraded": 1.5,
    "buy": 1.0,
    "overweight": 1.0,
    "strong buy": 2.0,
    "growth": 1.0,
    "profit": 1.5,
    "profitable": 1.5,
    "gain": 1.0,
    "gains": 1.0,
    "record high": 2.0,
    "bearish": -3.0,
    "underperform": -2.0,
    "miss": -2.0,
    "missed": -2.0,
    "misses": -2.0,
    "downgrade": -1.5,
    "downgraded": -1.5,
    "sell": -1.0,
    "underweight": -1.0,
    "strong sell": -2.0,
    "decline": -1.0,
    "declines": -1.0,
    "declined": -1.0,
    "loss": -1.5,
    "losses": -1.5,
    "bankruptcy": -3.0,
    "bankrupt": -3.0,
    "recession": -2.0,
    "recession fears": -2.5,
    "layoff": -1.5,
    "layoffs": -1.5,
    "litigation": -1.5,
    "lawsuit": -1.5,
    "regulatory": -1.0,
    "probe": -1.5,
    "investigation": -1.5,
}

# Fixed values of the published scoring rules (Hutto & Gilbert 2014): words that strengthen or
# weaken the word after them, and words that negate.
BOOST = 0.293
BOOSTERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply",
    "effing", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme",
    "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging",
    "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite",
    "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously",
    "uber", "unbelievably", "unusually", "utter", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally",
    "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta",
    "sortof", "sort-of",
)
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't", "can't",
    "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt",
    "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't", "neednt", "needn't", "never",
    "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't",
    "wouldn't", "rarely", "seldom", "despite",
)

# Words left out of topics.
STOP_WORDS = (
    "the", "and", "to", "of", "a", "in", "that", "is", "for", "on", "with", "said", "its", "was", "by", "as", "at",
    "from", "be", "an", "are", "has", "have", "had", "will", "would", "could", "should", "may", "can",
)


def lexicon_table(spark: SparkSession, terms: dict[str, float] | None = None) -> DataFrame:
    """``term, valence`` rows of a word list; the finance terms by default."""
    terms = FINANCE_TERMS if terms is None else terms
    return spark.createDataFrame(list(terms.items()), "term string, valence double")


def layered(base: DataFrame, top: DataFrame) -> DataFrame:
    """Union of two lexicons; terms of ``top`` replace those of ``base``."""
    kept = base.join(top.select("term"), "term", "left_anti")
    return kept.unionByName(top)


def finance_lexicon(spark: SparkSession, base: DataFrame | None = None) -> DataFrame:
    """The finance terms, laid over ``base`` if given."""
    table = lexicon_table(spark)
    return table if base is None else layered(base.select("term", F.col("valence").cast("double")), table)
