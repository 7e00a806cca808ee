"""A sequence tagger for entities, learnt from gazetteer hits: averaged perceptron, Viterbi decoding.

The gazetteer marks the names in a bounded sample of pieces of texts (``PIECES`` of at most ``PIECE_WORDS`` words); the
tagger learns from words, their beginnings, ends, shapes and neighbours, so it also finds names that neither gazetteer nor
sample has; a name of the sample that the gazetteer lacks is learnt as none. Only that sample reaches the driver. Decoding is a model for ``extract_entities`` and reads whole texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newstape.operators.entities import gazetteer_entities
from newstape.operators.gazetteer import word_form

#: Pieces of texts that the tagger is fitted and rated on at most, their words, and the share that only rates it.
PIECES, PIECE_WORDS, HELD_OUT = 2500, 48, 0.2
ROUNDS = 4
#: Words whose scores a task keeps, and words of texts that are decoded together.
KEPT_WORDS, WORDS_AT_ONCE = 150_000, 150_000

WORD = re.compile(r"[\w&'-]+")
OUTSIDE = "O"


def words_of(text: str) -> list[str]:
    """Runs of letters, digits, ``&``, ``'`` and ``-``, as in ``word_form``."""
    return WORD.findall(text.replace("_", " "))


def shape_of(word: str) -> str:
    """Capitals, small letters, digits and marks, runs counted once."""
    if word.isalpha() and word[1:].islower():  # most words
        return "a" if word.islower() else "Aa" if word[0].isupper() else "a"
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", "".join(kinds))


#: Kinds of features of a word itself, in the order in which their weights are added up, and their values.
OWN = {"w": str, "l": str.lower, "p": lambda word: word[:3], "s": lambda word: word[-3:], "h": shape_of}


def own_features(word: str) -> list[str]:
    return [*[f"{kind}={value(word)}" for kind, value in OWN.items()], "bias"]


def near_features(word: str | None, side: str) -> list[str]:
    return [f"{side}={word}"] if word is not None else [f"{side}!"]


def spans(tags: Sequence[str]) -> list[tuple[int, int, str]]:
    """(first word, word after the last, type) of every name; a name starts with ``B-`` and goes on with ``I-``."""
    found = []
    for i, tag in enumerate(tags):
        if tag.startswith("B-"):
            found.append([i, i + 1, tag[2:]])
        elif tag.startswith("I-") and found and found[-1][1] == i:
            found[-1][1] = i + 1
    return [tuple(f) for f in found]


def label_words(words: Sequence[str], names: Mapping[tuple[str, ...], str]) -> list[str]:
    """Tags by the names that occur: from left to right the longest one, none over another."""
    longest = max(map(len, names), default=0)
    tags, i = [OUTSIDE] * len(words), 0
    while i < len(words):
        size = next((k for k in range(min(longest, len(words) - i), 0, -1) if tuple(words[i : i + k]) in names), 0)
        if size:
            kind = names[tuple(words[i : i + size])]
            tags[i : i + size] = [f"B-{kind}"] + [f"I-{kind}"] * (size - 1)
        i += size or 1
    return tags


class Tagger:
    """``tagger(text)`` gives (entity, type) in the order of the text; ``f1`` is that of held-out pieces."""

    def __init__(self, types: Iterable[str]) -> None:
        self.tags = [OUTSIDE, *[f"{part}-{t}" for t in sorted(set(types)) for part in ("B", "I")]]
        n = len(self.tags)
        self.rows: dict[str, int] = {}
        self.weights = np.zeros((0, n))
        self.steps = np.zeros((n, n))
        # A name goes on only behind its own beginning.
        self.allowed = np.array([[not b.startswith("I-") or a[1:] == b[1:] for b in self.tags] for a in self.tags])
        self.starts = np.array([not b.startswith("I-") for b in self.tags])
        self.f1: float | None = None
        self._forget()

    def _forget(self) -> None:
        """Scores of the words met so far, by role: left neighbour, the word itself, right neighbour; row 0 is no word."""
        self._places: dict[str | None, int] = {None: 0}
        self._tables = np.zeros((3, 0, len(self.tags)))
        self._known: dict[str, dict[str, int]] = {}
        self._padded = self._tables[0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_padded", "_places", "_tables")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _begin(self) -> None:
        """Rows of the weights by kind and value of their features, and the scores of no word."""
        for name, row in self.rows.items():
            kind, _, value = name.partition("=")
            self._known.setdefault(kind, {})[value] = row
        self._padded = np.vstack([self.weights, np.zeros((1, len(self.tags)))])  # the last row is that of unknown features
        self._tables = np.stack([self._weights_of(kind, [""]) for kind in ("left!", "", "right!")])

    def _weights_of(self, kind: str, values: Iterable[str]) -> np.ndarray:
        known, none = self._known.get(kind, {}), len(self.weights)
        return self._padded[[known.get(v, none) for v in values]]

    def _numbered(self, words: Iterable[str]) -> np.ndarray:
        """Rows of the words in the tables, which grow by the words not met before."""
        places = self._places
        got = np.array([places.setdefault(w, len(places)) for w in words], np.int64)
        if not self._tables.shape[1]:
            self._begin()
        known = self._tables.shape[1]
        if len(places) > known:
            fresh = list(islice(places, known, None))
            rows = np.zeros((3, len(fresh), len(self.tags)))
            rows[0], rows[2] = self._weights_of("left", fresh), self._weights_of("right", fresh)
            for kind, value in OWN.items():
                rows[1] += self._weights_of(kind, map(value, fresh))
            rows[1] += self._weights_of("bias", [""])
            self._tables = np.concatenate([self._tables, rows], axis=1)
        return got

    def emissions(self, texts: Sequence[Sequence[str]]) -> np.ndarray:
        """Scores of all words of the texts, one text after the other, by tag."""
        at = self._numbered(w for words in texts for w in words)
        ends = np.cumsum([len(t) for t in texts])
        before, after = np.roll(at, 1), np.roll(at, -1)
        before[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = 0
        after[(ends - 1)[[len(t) > 0 for t in texts]]] = 0
        scores = self._tables[0][before]
        scores += self._tables[1][at]
        scores += self._tables[2][after]
        return scores

    def decode(self, words: Sequence[str]) -> list[str]:
        """The tags of the largest sum of word and step weights among all allowed sequences."""
        if not words:
            return []
        return [self.tags[t] for t in self._best(self.emissions([words]))]

    def _best(self, scores: np.ndarray) -> list[int]:
        steps = np.where(self.allowed, self.steps, -np.inf)
        back = np.zeros(scores.shape, np.int16)
        here = np.where(self.starts, scores[0], -np.inf)
        for i in range(1, len(scores)):
            ways = here[:, None] + steps
            back[i] = ways.argmax(axis=0)
            here = ways.max(axis=0) + scores[i]
        path = [int(here.argmax())]
        for i in range(len(scores) - 1, 0, -1):
            path.append(int(back[i, path[-1]]))
        return path[::-1]

    def _best_of_all(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``_best`` of many texts, none of them empty, word by word over all texts that are long enough."""
        steps = np.where(self.allowed, self.steps, -np.inf)
        ranks = np.argsort(np.argsort(-sizes, kind="stable"), kind="stable")  # the longest text comes first
        going = np.searchsorted(np.sort(-sizes), -np.arange(1, sizes.max() + 1), side="right")  # texts of more than t words
        starts = np.cumsum(going) - going
        # The words lie first word by first word, then second by second, ..., so each step reads one stretch.
        moment = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = starts[moment] + np.repeat(ranks, sizes)
        sums = np.empty(scores.shape[::-1])  # of the best way to each tag of each word, at first its own scores
        sums[:, place] = scores.T
        here = sums[:, : going[0]]
        here[~self.starts] = -np.inf
        for at, k in zip(starts[1:].tolist(), going[1:].tolist()):
            before, here = here, sums[:, at : at + k]
            here += (before[:, None, :k] + steps[:, :, None]).max(axis=0)
        # Back from the last words: the tag before is the one that the largest sum came from.
        path, tags = np.empty(len(scores), np.int64), np.empty(0, np.int64)
        for at, k in zip(starts[::-1].tolist(), going[::-1].tolist()):
            own = sums[:, at : at + k]
            own[:, : len(tags)] += steps[:, tags]
            path[at : at + k] = tags = own.argmax(axis=0)
        return path[place]

    def many(self, texts: Iterable[str]) -> Iterator[list[tuple[str, str]]]:
        """The names of each text, a repeated one where it comes last, with its last type."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(words_of(text))
            held += len(waiting[-1])
            if held > WORDS_AT_ONCE:
                yield from self._names(waiting)
                waiting, held = [], 0
        yield from self._names(waiting)

    def _names(self, texts: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
        if len(self._places) > KEPT_WORDS:
            self._forget()
        sizes = np.array([len(t) for t in texts], np.int64)
        path = self._best_of_all(self.emissions(texts), sizes[sizes > 0]) if sizes.any() else np.zeros(0, np.int64)
        start = 0
        for words, size in zip(texts, sizes):
            tags = path[start : start + size]
            start += size
            found: dict[str, str] = {}
            begun = np.flatnonzero(tags % 2)  # B- tags have odd numbers, the I- tag of a type follows its B- tag
            inside = tags % 2 + 2 * (tags > 0) == 2
            for i in begun.tolist():
                j = i + 1
                while j < size and inside[j]:
                    j += 1
                name = " ".join(words[i:j])
                found.pop(name, None)
                found[name] = self.tags[tags[i]][2:]
            yield list(found.items())

    def __call__(self, text: str) -> list[tuple[str, str]]:
        return next(self.many([text]))

    def fit(self, pieces: Sequence[tuple[list[str], list[str]]], rounds: int = ROUNDS, seed: int = 7) -> Tagger:
        """Perceptron updates over (words, tags), weights averaged over all of them."""
        number = {t: i for i, t in enumerate(self.tags)}
        coded = []
        for words, tags in pieces:
            ends = [None, *words, None]
            rows = []
            for i, w in enumerate(words):
                names = own_features(w) + near_features(ends[i], "left") + near_features(ends[i + 2], "right")
                rows.append([self.rows.setdefault(n, len(self.rows)) for n in names])
            coded.append((np.array(rows), np.array([number[t] for t in tags])))
        n = len(self.tags)
        weights, steps = np.zeros((len(self.rows), n)), np.zeros((n, n))
        past, past_steps = np.zeros_like(weights), np.zeros_like(steps)  # updates times the moment they came
        draw, moment = random.Random(seed), 1
        for _ in range(rounds):
            draw.shuffle(coded)
            for rows, gold in coded:
                self.steps = steps
                said = np.array(self._best(weights[rows].sum(axis=1)))
                for i in np.flatnonzero(said != gold):
                    for tag, sign in ((gold[i], 1.0), (said[i], -1.0)):
                        np.add.at(weights, (rows[i], tag), sign)
                        np.add.at(past, (rows[i], tag), sign * moment)
                for path, sign in ((gold, 1.0), (said, -1.0)):
                    np.add.at(steps, (path[:-1], path[1:]), sign)
                    np.add.at(past_steps, (path[:-1], path[1:]), sign * moment)
                moment += 1
        weights, self.steps = weights - past / moment, steps - past_steps / moment
        used = [(name, i) for name, i in self.rows.items() if weights[i].any()]
        self.weights = weights[[i for _, i in used]]
        self.rows = {name: i for i, (name, _) in enumerate(used)}
        self._forget()
        return self

    def rate(self, pieces: Sequence[tuple[list[str], list[str]]]) -> float | None:
        """F1 of whole names (place and type); None where neither side has any."""
        hits = said = true = 0
        for words, tags in pieces:
            found, wanted = set(spans(self.decode(words))), set(spans(tags))
            hits, said, true = hits + len(found & wanted), said + len(found), true + len(wanted)
        return 2 * hits / (said + true) if said + true else None


def marked_pieces(texts: DataFrame, gazetteer: DataFrame, text: str, pieces: int = PIECES) -> list[tuple[list[str], list[str]]]:
    """The sample: whole texts cut into pieces, ``pieces`` of them chosen by a hash of their words, tagged by the gazetteer.

    Equal pieces count once. Of types that one name has, the smallest counts.
    """
    spark = texts.sparkSession
    words = F.filter(F.split(word_form(text), " "), lambda w: w != "")
    listed = texts.select(words.alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.size("_words"), F.lit(PIECE_WORDS))
    cut = listed.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_words", i, PIECE_WORDS), " "))).alias("piece"))
    chosen = cut.select(F.xxhash64("piece").alias("_lot"), "piece").distinct().orderBy("_lot", "piece").limit(pieces)
    rows = [(i, r.piece) for i, r in enumerate(chosen.collect())]  # at most `pieces` short texts
    sample = spark.createDataFrame(rows, "piece_id int, piece string")
    found: dict[int, dict[tuple[str, ...], str]] = {}
    for r in gazetteer_entities(sample, gazetteer, ["piece_id"], "piece").collect():  # names in those pieces
        form = tuple(words_of(r.entity))
        own = found.setdefault(r.piece_id, {})
        own[form] = min(own.get(form, r.entity_type), r.entity_type)
    split = [(i, p.split(" ")) for i, p in rows]
    return [(w, label_words(w, found.get(i, {}))) for i, w in split]


def train_tagger(texts: DataFrame, gazetteer: DataFrame, text: str = "headline", pieces: int = PIECES, rounds: int = ROUNDS) -> Tagger:
    """A tagger fitted on four fifths of the sample, its ``f1`` from the rest. Texts that are NULL or hold no word take no
    part; without any piece or any name it finds nothing."""
    marked = marked_pieces(texts, gazetteer, text, pieces)
    cut = len(marked) - int(len(marked) * HELD_OUT)
    tagger = Tagger(tag[2:] for _, tags in marked for tag in tags if tag != OUTSIDE).fit(marked[:cut], rounds)
    tagger.f1 = tagger.rate(marked[cut:])
    return tagger
