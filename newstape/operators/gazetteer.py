"""Names of a gazetteer in texts: a trie over words with failure links, one pass over each text.

Names and texts are brought to one form by ``word_form``: marks other than ``&``, ``'`` and ``-`` part words. A state
of the automaton stands for the words read last that begin a name; a word that does not go on follows the failure links to
the longest shorter beginning. A state lists the names that end there, so nested and overlapping names are all found.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that an automaton holds at most, as it travels to every worker; a larger gazetteer is joined by first words.
AUTOMATON_NAMES = 20_000
HIT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("entity_type", T.StringType())])


def word_form(text: str | Column) -> Column:
    """Words joined by one space: runs of letters, digits, ``&``, ``'`` and ``-``. NULL becomes the empty text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N}&'-]+", " "))


class Automaton(NamedTuple):
    """``words``: numbers of words; ``steps``: (state, word) to state; ``fails``: failure link of each state; ``ends``: the
    names that end in each state, the nested ones included."""

    words: dict[str, int]
    steps: dict[tuple[int, int], int]
    fails: list[int]
    ends: list[tuple[int, ...]]


def build(forms: Iterable[str]) -> Automaton:
    """The automaton of names in word form; empty ones never match. Equal names all count."""
    words: dict[str, int] = {}
    steps: dict[tuple[int, int], int] = {}
    below: list[list[tuple[int, int]]] = [[]]
    own: list[list[int]] = [[]]
    for number, form in enumerate(forms):
        state = 0
        for word in form.split():
            code = words.setdefault(word, len(words))
            after = steps.get((state, code))
            if after is None:
                after = steps[state, code] = len(own)
                below[state].append((code, after))
                below.append([])
                own.append([])
            state = after
        if state:
            own[state].append(number)
    fails, ends = [0] * len(own), [tuple(o) for o in own]
    waiting = deque([0])
    while waiting:
        state = waiting.popleft()
        for code, after in below[state]:
            waiting.append(after)
            if state:
                back = fails[state]
                while back and (back, code) not in steps:
                    back = fails[back]
                fails[after] = steps.get((back, code), 0)
            ends[after] = ends[after] + ends[fails[after]]
    return Automaton(words, steps, fails, ends)


def find(automaton: Automaton, form: str) -> list[int]:
    """Numbers of the names in a text in word form, each once, ascending."""
    words, steps, fails, ends = automaton
    found: set[int] = set()
    state = 0
    for word in form.split(" "):
        code = words.get(word)
        if code is None:
            state = 0
            continue
        while state and (state, code) not in steps:
            state = fails[state]
        state = steps.get((state, code), 0)
        if ends[state]:
            found.update(ends[state])
    return sorted(found)


def hits(texts: DataFrame, names: list, form: str = "_form", out: str = "_names") -> DataFrame:
    """Replaces the column ``form`` by ``out``, an array of (entity, entity_type) of the names that the row's text holds.

    ``names`` are at most ``AUTOMATON_NAMES`` rows of (entity, entity_type, form); the automaton travels with the tasks.
    """
    sent = texts.sparkSession.sparkContext.broadcast((tuple(build(n[2] for n in names)), [n[:2] for n in names]))
    kept = [c for c in texts.columns if c != form]
    pair = pa.struct([("entity", pa.string()), ("entity_type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rows = Automaton(*sent.value[0]), [dict(zip(("entity", "entity_type"), n)) for n in sent.value[1]]
        for batch in batches:
            lists = [[rows[i] for i in find(automaton, text or "")] for text in batch.column(form).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(lists, pa.list_(pair))], [*kept, out])

    return texts.mapInArrow(run, texts.select(kept).schema.add(out, T.ArrayType(HIT)))


def small_gazetteer(gazetteer: DataFrame, most: int = AUTOMATON_NAMES) -> list | None:
    """(entity, entity_type, form) of all names, if there are no more than ``most``; the driver reads ``most`` + 1 rows at most."""
    names = gazetteer.where("entity is not null").select("entity", "entity_type", word_form("entity"))
    rows = [tuple(r) for r in names.limit(most + 1).collect()]
    return rows if len(rows) <= most else None
