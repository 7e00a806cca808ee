"""Parts of stored web pages by selectors: one tolerant parse a page, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: elements without an end tag, elements whose text is not shown, and which open elements a start tag
# ends by itself, up to the nearest of some others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
} | {tag: ({"p"}, {"table", "td", "th", "button", "object"}) for tag in _BLOCKS.split()}


class Step(NamedTuple):
    """One element of a selector: ``tag``, ``#id`` and ``.class`` as far as they are given."""

    tag: str | None
    ident: str | None
    classes: frozenset[str]

    def fits(self, element: Element) -> bool:
        return (
            self.tag in (None, element.tag)
            and self.ident in (None, element.ident)
            and self.classes <= element.classes
        )


class Element(NamedTuple):
    tag: str
    ident: str | None
    classes: frozenset[str]


def steps_of(selector: str) -> list[list[Step]]:
    """``table#news tr, div.list a`` as chains of steps: alternatives by comma, descendants by space, ``*`` for any tag."""
    chains = []
    for alternative in selector.split(","):
        chain = []
        for word in alternative.split():
            if not re.fullmatch(r"(\*|[\w-]+)?([#.][\w-]+)*", word):
                raise ValueError(f"selector {selector!r}: {word!r} is not a tag, #id, .class or several of them")
            tag = re.match(r"[\w-]+", word)
            ident = re.search(r"#([\w-]+)", word)
            chain.append(Step(tag and tag[0].lower(), ident and ident[1], frozenset(re.findall(r"\.([\w-]+)", word))))
        if not chain:
            raise ValueError(f"selector {selector!r} has an empty part")
        chains.append(chain)
    return chains


def chain_fits(chain: Sequence[Step], path: Sequence[Element]) -> bool:
    """Whether the last element of the path ends the chain, the other steps lying above it in their order."""
    if not path or not chain[-1].fits(path[-1]):
        return False
    left = len(chain) - 1
    for element in reversed(path[:-1]):
        if left and chain[left - 1].fits(element):
            left -= 1
    return not left


class Field(NamedTuple):
    chains: list[list[Step]] | None  # None: the item itself
    attribute: str | None
    number: int

    @classmethod
    def of(cls, text: str) -> Field:
        """``selector`` (text of the first match inside the item), ``selector[2]`` (of the second), ``selector@href``
        (its attribute), ``.`` (the item itself)."""
        selector, _, attribute = text.partition("@")
        number = re.search(r"\[(\d+)\]$", selector)
        selector = re.sub(r"\[\d+\]$", "", selector).strip()
        return cls(None if selector == "." else steps_of(selector), attribute.strip() or None, int(number[1]) if number else 1)


class _Items(HTMLParser):
    def __init__(self, item: list[list[Step]], fields: Sequence[Field]) -> None:
        super().__init__(convert_charrefs=True)
        self.item, self.fields = item, fields
        self.path: list[Element] = []
        self.items: list[list[str | None]] = []
        self.open: list[tuple[int, int, list[int]]] = []  # depth of an open item, its number, matches so far by field
        self.texts: list[tuple[int, int, int]] = []  # depth, item and field of the texts being read

    def _close_to(self, depth: int) -> None:
        del self.path[depth:]
        self.open = [o for o in self.open if o[0] < depth]
        self.texts = [t for t in self.texts if t[0] < depth]

    def _nearest(self, tags: set[str], stops: set[str]) -> int | None:
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].tag in tags:
                return i
            if self.path[i].tag in stops:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            ended = self._nearest(*ENDS[tag])
            if ended is not None:
                self._close_to(ended)
        given = dict(attrs)
        depth = len(self.path)
        self.path.append(Element(tag, given.get("id"), frozenset((given.get("class") or "").split())))
        for start, number, seen in self.open:
            for f, field in enumerate(self.fields):
                if field.chains and any(chain_fits(c, self.path[start + 1 :]) for c in field.chains):
                    seen[f] += 1
                    if seen[f] == field.number:
                        self._take(depth, number, f, given)
        if any(chain_fits(c, self.path) for c in self.item):
            self.items.append([None] * len(self.fields))
            self.open.append((depth, len(self.items) - 1, [0] * len(self.fields)))
            for f, field in enumerate(self.fields):
                if field.chains is None:
                    self._take(depth, len(self.items) - 1, f, given)
        if tag in VOID:
            self._close_to(depth)

    def _take(self, depth: int, number: int, f: int, given: dict) -> None:
        attribute = self.fields[f].attribute
        if attribute:
            self.items[number][f] = given.get(attribute, None) if given.get(attribute, "") is not None else ""
        else:
            self.items[number][f] = ""
            self.texts.append((depth, number, f))

    def handle_endtag(self, tag: str) -> None:
        ended = self._nearest({tag}, ENDS[tag][1] - {tag} if tag in ENDS else set())
        if ended is not None:
            self._close_to(ended)

    def handle_data(self, data: str) -> None:
        if self.path and self.path[-1].tag in HIDDEN:
            return
        for _, number, f in self.texts:
            self.items[number][f] += data


def select_items(pages: DataFrame, item: str, fields: Mapping[str, str], html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per element that fits ``item``: ``keep`` columns, ``row_idx`` (its number on the page) and the fields.

    A field is ``selector``, ``selector[n]``, ``selector@attribute`` or ``.`` (see ``Field.of``); what is not there is NULL.
    Texts are whole and trimmed, scripts and styles left out. Items may be nested; an outer one sees what an inner one
    holds. Broken markup is read as far as it goes; NULL and empty pages give no rows.
    """
    names, wanted, chains = list(fields), [Field.of(t) for t in fields.values()], steps_of(item)
    texts = [field.attribute is None for field in wanted]
    keep = list(keep)
    shape = T.StructType([*[pages.schema[k] for k in keep], T.StructField("row_idx", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *kept, page in batch[[*keep, "_html"]].itertuples(index=False, name=None):
                if not page:
                    continue
                parser = _Items(chains, wanted)
                parser.feed(page)
                parser.close()
                for i, found in enumerate(parser.items):
                    rows.append((*kept, i, *[v.strip() if t and v is not None else v for v, t in zip(found, texts)]))
            yield pd.DataFrame(rows, columns=[f.name for f in shape])

    return pages.select(*keep, pages[html].alias("_html")).mapInPandas(run, shape)
