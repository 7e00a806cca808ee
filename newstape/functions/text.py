"""Text cleaning and word splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode sees it, plus the four ASCII separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
# Characters stripped from both ends of a word: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def clean_text(c: Column | str) -> Column:
    """Lower case, no links, only ASCII letters, digits, white space and ``.,!?-``; NULL -> ''."""
    lower = F.lower(F.coalesce(_col(c), F.lit("")))
    unlinked = F.regexp_replace(lower, r"(?U)(http|www)[^\s\x1c-\x1f]+", "")
    plain = F.regexp_replace(unlinked, r"(?U)[^a-zA-Z0-9\s\x1c-\x1f.,!?-]", "")
    return _squeeze(plain)


def clean_text_light(c: Column | str) -> Column:
    """White space collapsed, case and symbols kept; NULL -> ''."""
    return _squeeze(F.coalesce(_col(c), F.lit("")))


def words_of(c: Column | str) -> Column:
    """Words of a cleaned text (single blanks): punctuation is stripped from both ends unless 2 or
    fewer characters would be left, so that short symbols such as ``:)`` survive."""
    raw = F.filter(F.split(_col(c), " "), lambda w: w != "")

    def strip(w: Column) -> Column:
        bare = F.btrim(w, F.lit(PUNCTUATION))
        return F.when(F.length(bare) <= 2, w).otherwise(bare)

    return F.transform(raw, strip)


def plain_words(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    split = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(split, lambda w: w != "")


def sentiment_category(score: Column | str) -> Column:
    score = _col(score)
    return F.when(score >= 0.05, "Positive").when(score <= -0.05, "Negative").otherwise("Neutral")


def truncate_text(c: Column | str, n: int = 1000) -> Column:
    """First n characters. An option for callers; extraction here reads whole texts."""
    return F.substring(_col(c), 1, n)
