"""Rule-based sentiment of a text as one Catalyst expression, linear in the text length.

Rules (Hutto & Gilbert 2014): word valences from a lexicon, strengthening words up to three places
before, negation, capitals, "but", "least", exclamation and question marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newstape.functions.lexicon import BOOST, BOOSTERS, DAMPENERS, NEGATIONS
from newstape.functions.text import words_of

# Fixed values of the published rules.
CAPS = 0.733
NEGATED = -0.74
ALPHA = 15.0
EXCLAMATION = 0.292
QUESTION = 0.18
MANY_QUESTIONS = 0.96
DAMPING = (1.0, 0.95, 0.9)

# Valence of a word, NULL where the lexicon does not know it.
Lookup = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once: without it Catalyst would repeat the expression at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup_in(terms: dict[str, float]) -> Lookup:
    """Valences from a word list held in the plan: hash-set membership, then one set per valence."""
    by_valence: dict[float, list[str]] = {}
    for term, valence in terms.items():
        by_valence.setdefault(float(valence), []).append(term.lower())
    members = [term for group in by_valence.values() for term in group]

    def value(word: Column) -> Column:
        branches = F.lit(None).cast("double")
        for valence, group in by_valence.items():
            branches = F.when(word.isin(group), F.lit(valence)).otherwise(branches)
        return F.when(word.isin(members), branches)

    return value


def _boost(word: Column) -> Column:
    return F.when(word.isin(*BOOSTERS), F.lit(BOOST)).when(word.isin(*DAMPENERS), F.lit(-BOOST))


def _negates(word: Column) -> Column:
    return word.isin(*NEGATIONS) | word.contains("n't")


def _is_caps(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _at(words: Column, i: Column) -> Column:
    """Word at i, '' outside the text."""
    return F.when(i >= 0, F.coalesce(F.get(words, i), F.lit(""))).otherwise(F.lit(""))


def _word_valence(
    words: Column, lows: Column, known: Column, i: Column, some_caps: Column | None
) -> Column:
    """Valence of the lexicon word at i after all rules that look at its neighbours.

    ``known`` holds the plain valence of every word. ``some_caps`` is None where the text is known
    to be lower case.
    """
    low = F.get(lows, i)
    start = F.get(known, i)
    if some_caps is not None:
        louder = _is_caps(F.get(words, i)) & some_caps
        start = start + F.when(louder, F.when(start > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)

    def look_back(distance: int) -> Callable[[Column], Column]:
        before = i - distance
        word, near, mid = _at(lows, before), _at(lows, i - 1), _at(lows, i - 2)

        def strengthen(valence: Column) -> Column:
            raw = _boost(word)
            signed = F.when(valence < 0, -raw).otherwise(raw)
            if some_caps is not None:
                signed = signed + F.when(
                    _is_caps(_at(words, before)) & some_caps,
                    F.when(valence > 0, CAPS).otherwise(-CAPS),
                ).otherwise(0.0)
            return valence + F.coalesce(signed * DAMPING[distance - 1], F.lit(0.0))

        def negate(valence: Column) -> Column:
            flipped = F.when(_negates(word), valence * NEGATED).otherwise(valence)
            if distance == 1:
                return flipped
            if distance == 2:
                return (
                    F.when((word == "never") & near.isin("so", "this"), valence * 1.25)
                    .when((word == "without") & (near == "doubt"), valence)
                    .otherwise(flipped)
                )
            return (
                F.when(
                    ((word == "never") & mid.isin("so", "this")) | near.isin("so", "this"),
                    valence * 1.25,
                )
                .when((word == "without") & ((mid == "doubt") | (near == "doubt")), valence)
                .otherwise(flipped)
            )

        def step(valence: Column) -> Column:
            applies = (before >= 0) & F.get(known, before).isNull()
            return F.when(applies, let(strengthen(valence), negate)).otherwise(valence)

        return step

    def least(valence: Column) -> Column:
        near, mid = _at(lows, i - 1), _at(lows, i - 2)
        turned = (near == "least") & F.get(known, i - 1).isNull() & ~mid.isin("at", "very")
        return F.when(turned, valence * NEGATED).otherwise(valence)

    one, two, three = (look_back(d) for d in (1, 2, 3))
    value = let(start, lambda a: let(one(a), lambda b: let(two(b), lambda c: let(three(c), least))))
    kind_of = (low == "kind") & (_at(lows, i + 1) == "of")
    return F.when(_boost(low).isNotNull() | kind_of, F.lit(0.0)).otherwise(value)


def _marks(text: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    questions = count("?")
    return F.least(count("!"), F.lit(4)) * EXCLAMATION + (
        F.when(questions <= 1, 0.0).when(questions <= 3, questions * QUESTION).otherwise(MANY_QUESTIONS)
    )


def normalized(total: Column) -> Column:
    """Sum of valences squeezed into -1..1."""
    return F.try_divide(total, F.sqrt(total * total + ALPHA))


def score_expr(
    text: Column,
    find: Lookup | None,
    rules: bool = True,
    empty_neutral: float = 0.0,
    phrases: Lookup | None = None,
    lower_case: bool = False,
    known: Column | None = None,
    known_pairs: Column | None = None,
) -> Column:
    """Struct ``compound, pos, neu, neg`` of a cleaned text (single blanks between words).

    ``rules=False`` keeps the word valences only. ``phrases`` adds the valence of adjacent word
    pairs, carried by the first word of the pair. ``empty_neutral`` is ``neu`` of a text without
    words. ``lower_case`` tells that the text has no capitals, which saves two passes.
    Instead of ``find`` and ``phrases``, ``known`` and ``known_pairs`` may give the valences of all words and of the pairs
    that they begin, as arrays (NULL: none).
    """
    empty = F.struct(
        F.lit(0.0).alias("compound"),
        F.lit(0.0).alias("pos"),
        F.lit(float(empty_neutral)).alias("neu"),
        F.lit(0.0).alias("neg"),
    )

    with_pairs = phrases is not None or known_pairs is not None

    def with_words(words: Column) -> Column:
        if lower_case:
            return scored(words, words)
        return let(F.transform(words, F.lower), lambda lows: scored(words, lows))

    def scored(words: Column, lows: Column) -> Column:
        # The lexicon is looked at once per word; everything after reads the array of valences.
        if known is not None:
            return with_valences(words, lows, known)
        return let(F.transform(lows, find), lambda known: with_valences(words, lows, known))

    def with_valences(words: Column, lows: Column, known: Column) -> Column:
        n = F.size(known)
        places = F.sequence(F.lit(0), n - 1)

        def pair(i: Column) -> Column:
            if known_pairs is not None:
                return F.get(known_pairs, i)
            return phrases(F.concat_ws(" ", F.get(lows, i), F.get(lows, i + 1)))

        def is_hit(i: Column) -> Column:
            hit = F.get(known, i).isNotNull()
            return hit | pair(i).isNotNull() if with_pairs else hit

        def values(some_caps: Column | None, but: Column | None) -> Column:
            def value(i: Column) -> Column:
                plain = _word_valence(words, lows, known, i, some_caps) if rules else F.get(known, i)
                if with_pairs:
                    plain = F.coalesce(pair(i), plain)
                if but is None:
                    return plain
                weight = F.when(but < 0, 1.0).when(i < but, 0.5).when(i > but, 1.5).otherwise(1.0)
                return plain * weight

            return F.transform(F.filter(places, is_hit), value)

        if not rules:
            return let(values(None, None), lambda found: summed(found, n))
        # Facts about the whole text are bound once, outside the loop over its words.
        but = F.array_position(lows, F.lit("but")).cast("int") - 1
        if lower_case:
            return let(but, lambda b: let(values(None, b), lambda found: summed(found, n)))
        capitals = F.size(F.filter(words, _is_caps))
        some_caps = (capitals > 0) & (capitals < n)
        facts = F.struct(some_caps.alias("caps"), but.alias("but"))
        return let(
            facts, lambda f: let(values(f["caps"], f["but"]), lambda found: summed(found, n))
        )

    def summed(found: Column, n: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("m"), F.lit(0).alias("k"))
        totals = F.aggregate(
            found,
            zero,
            lambda acc, v: F.struct(
                (acc["s"] + v).alias("s"),
                (acc["p"] + F.when(v > 0, v + 1.0).otherwise(0.0)).alias("p"),
                (acc["m"] + F.when(v < 0, v - 1.0).otherwise(0.0)).alias("m"),
                (acc["k"] + F.when(v != 0, 1).otherwise(0)).alias("k"),
            ),
        )
        return let(totals, lambda t: let(_marks(text) if rules else F.lit(0.0), lambda m: result(t, m, n)))

    def result(t: Column, marks: Column, n: Column) -> Column:
        total = t["s"] + F.when(t["s"] > 0, marks).when(t["s"] < 0, -marks).otherwise(0.0)
        pos = t["p"] + F.when(t["p"] > F.abs(t["m"]), marks).otherwise(0.0)
        neg = t["m"] - F.when(t["p"] < F.abs(t["m"]), marks).otherwise(0.0)
        neu = n - t["k"]

        def shares(parts: Column) -> Column:
            whole = parts["pos"] + F.abs(parts["neg"]) + parts["neu"]
            return F.struct(
                F.round(normalized(parts["total"]), 4).alias("compound"),
                F.round(F.try_divide(parts["pos"], whole), 3).alias("pos"),
                F.round(F.try_divide(parts["neu"], whole), 3).alias("neu"),
                F.round(F.try_divide(F.abs(parts["neg"]), whole), 3).alias("neg"),
            )

        return let(
            F.struct(
                total.alias("total"), pos.alias("pos"), neg.alias("neg"), neu.cast("double").alias("neu")
            ),
            shares,
        )

    if known is not None and not rules:
        return F.when(F.size(known) == 0, empty).otherwise(with_valences(known, known, known))
    return let(
        words_of(text),
        lambda words: F.when(F.size(words) == 0, empty).otherwise(with_words(words)),
    )
