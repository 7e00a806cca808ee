"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch of texts is cut at white space into units, the distinct units into words by the tokenizer's pattern, and the
distinct words of the batch are merged together: all their symbols lie in one flat array, every round finds each
word's pair of lowest rank by binary search over the sorted pair keys and merges all its occurrences, left to right.
Finished words leave the array. Ids of texts are gathered from those of their units.

The vocabulary is a ``tokenizers`` JSON file (byte-level BPE with the usual pattern). It is read once, on the driver,
and travels with the tasks: its size is that of the file, whatever the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstape.llm.common import give_back, slices, strings_of

#: The pattern of byte-level pre-tokenization (fixed by the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of that pattern: Unicode's White_Space, without the information separators that Python adds.
SPACE = r"\p{White_Space}"
SPACES = "[\\t-\\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Text bytes that are encoded together.
BATCH_BYTES = 2 << 20

_words = regex.compile(PATTERN.replace(r"\s", SPACE).replace(r"\S", r"\P{White_Space}"))
_units = regex.compile(rf"{SPACE}*\P{{White_Space}}+|{SPACE}+")


class Vocabulary(NamedTuple):
    """``keys``: pairs as left << 32 | right, sorted, with their ranks and what they merge into."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    data: np.ndarray
    offsets: np.ndarray


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in such files: itself, or one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    vocab, byte_of = stored["model"]["vocab"], byte_characters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    byte_ids = np.zeros(256, np.int64)
    for char, byte in byte_of.items():
        byte_ids[byte] = vocab[char]
    special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
    tokens = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in special}
    tokens |= {i: content.encode() for content, i in special.items()}
    table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    return Vocabulary(byte_ids, keys[order], order, merged[order], special, np.frombuffer(b"".join(table), np.uint8), offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of pieces, one piece after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat((starts - (ends - lengths)).astype(np.int32 if total < 1 << 31 else np.int64), lengths)
    out += np.arange(total, dtype=out.dtype)
    return out


def _ranks(keys: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Place and rank of each pair among the sorted pair keys; the rank is their number where there is no such pair."""
    at = np.minimum(np.searchsorted(vocab.keys, keys), len(vocab.keys) - 1)
    return at, np.where(vocab.keys[at] == keys, vocab.ranks[at], len(vocab.ranks))


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each word has.

    Each symbol keeps the rank of its pair with the next one; a round looks up only the pairs next to its merges.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    symbols, word = vocab.byte_ids[data], np.repeat(np.arange(len(words)), lengths)
    none = len(vocab.ranks)
    at, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), none, np.int64)
    if len(data) > 1:  # pairs of bytes: all there can be are looked up once
        every = _ranks((vocab.byte_ids[:, None] << 32 | vocab.byte_ids).reshape(-1), vocab)
        pair = data[:-1].astype(np.int64) << 8 | data[1:]
        at[:-1] = every[0][pair]
        rank[:-1] = np.where(word[:-1] == word[1:], every[1][pair], none)
    done_words, done_symbols = [], []
    while len(symbols):
        begins = np.concatenate([[True], word[1:] != word[:-1]])
        best = np.repeat(low := np.minimum.reduceat(rank, first := np.flatnonzero(begins)), np.diff(first, append=len(symbols)))
        pairs = np.flatnonzero((rank == best) & (rank < none))
        run = np.concatenate([[True], np.diff(pairs) > 1]) if len(pairs) else np.zeros(0, bool)
        place = np.arange(len(pairs)) - np.maximum.accumulate(np.where(run, np.arange(len(pairs)), 0))
        pairs = pairs[place % 2 == 0]
        symbols[pairs] = vocab.merged[at[pairs]]
        keep = np.ones(len(symbols), bool)
        keep[pairs + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[pairs] = True
        changed[pairs[pairs > 0] - 1] = True
        if (low == none).any():
            going = best < none
            ended = ~going & keep
            done_words.append(word[ended])
            done_symbols.append(symbols[ended])
            keep &= going
        symbols, word, at, rank, changed = symbols[keep], word[keep], at[keep], rank[keep], changed[keep]
        near = np.flatnonzero(changed)
        inside = near[near + 1 < len(symbols)]
        inside = inside[word[inside] == word[inside + 1]]
        rank[near] = none
        at[inside], rank[inside] = _ranks(symbols[inside] << 32 | symbols[inside + 1], vocab)
    if not done_words:
        return np.zeros(0, np.int64), lengths
    word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
    return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


def _unit_ids(pieces: list[str], units: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in a row of ``pieces``, a space before each, and of ``units``; where each begins; how many ids it has.

    Pieces hold no space and no white space at their ends, so one search finds the words of all: no word reaches from
    one piece into the next, and those that begin with a space begin a piece. A special token is a unit of its own.
    """
    words = _words.findall("".join([" ", " ".join(pieces)])) if pieces else []
    found = [[unit] if unit in vocab.special else _words.findall(unit) for unit in units]
    inside = pc.starts_with(every := pa.array(chain(words, *found), pa.large_string()), " ").to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(inside[: len(words)].astype(bool))
    count = np.concatenate([np.diff(begins, append=len(words)), np.fromiter(map(len, found), np.int64, len(found))])
    coded = every.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    ids, lengths = merge_words(coded.dictionary.cast(pa.large_binary()).to_pylist(), vocab)
    starts, ids = np.cumsum(lengths) - lengths, ids.astype(np.int32)
    ends = np.cumsum(count)
    for i, unit in enumerate(units):
        if unit in vocab.special:
            word = code[ends[len(pieces) + i] - 1]
            starts[word], lengths[word] = len(ids), 1
            ids = np.append(ids, np.int32(vocab.special[unit]))
    flat = ids[ragged(starts[code], lengths[code])]
    bounds = np.concatenate([[0], np.cumsum(lengths[code])])[np.concatenate([[0], ends])]
    return flat, bounds[:-1], np.diff(bounds)


def _odd_pieces(pieces: pa.Array, vocab: Vocabulary) -> np.ndarray:
    """Whether a piece between spaces is empty, begins or ends with white space, or has a special token."""
    odd = pc.match_substring_regex(pieces, f"^$|^{SPACES}|{SPACES}$")
    for content in vocab.special:
        odd = pc.or_(odd, pc.match_substring(pieces, content))
    return odd.to_numpy(zero_copy_only=False).astype(bool)


def encode_texts(texts: pa.Array, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each text has."""
    pieces = pc.split_pattern(texts, " ")
    offsets = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    coded = pieces.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    # A unit is a piece with the space before it, unless white space meets there or a special token occurs.
    odd = _odd_pieces(coded.dictionary, vocab)
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    strange = np.bincount(text[odd[codes]], minlength=len(counts)) > 0
    codes *= 2
    codes[offsets[:-1][counts > 0]] += 1
    plain = ~strange[text]
    wanted = np.zeros(2 * len(distinct), bool)
    wanted[codes[plain]] = True
    place = np.concatenate([np.cumsum(wanted[::2]) - 1, np.cumsum(wanted[1::2]) - 1 + wanted[::2].sum()])
    place = place.reshape(2, -1).T.reshape(-1)[codes[plain]]
    # Pieces after a space come first, those that begin a text behind them.
    spaced, leading = np.flatnonzero(wanted[::2]), np.flatnonzero(wanted[1::2])
    seen: dict[str, int] = {}
    others, sizes = [], []
    cut = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")") if vocab.special else None
    for i in np.flatnonzero(strange).tolist():
        parts = cut.split(texts[i].as_py()) if cut else [texts[i].as_py()]
        own = [u for part in parts for u in ([part] if part in vocab.special else _units.findall(part))]
        others.extend([seen.setdefault(u, len(seen)) for u in own])
        sizes.append(len(own))
    texts_of_units = [list(map(distinct.__getitem__, some.tolist())) for some in (spaced, leading)]
    flat, starts, lengths = _unit_ids(texts_of_units[0], texts_of_units[1] + list(seen), vocab)
    unit = np.concatenate([place, np.array(others, np.int64) + len(spaced) + len(leading)])
    owner = np.concatenate([text[plain], np.repeat(np.flatnonzero(strange), np.array(sizes, np.int64))])
    if len(others):
        order = np.argsort(owner, kind="stable")
        unit, owner = unit[order], owner[order]
    ids = flat[ragged(starts[unit], lengths[unit])]
    return ids, np.bincount(owner, weights=lengths[unit], minlength=len(counts)).astype(np.int64)


def _parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``BATCH_BYTES`` each, one row at least."""
    number = np.cumsum(sizes) // BATCH_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of ``text`` as an array (no special tokens added; their spelling in a text is one token).

    A null text is an empty one: no ids. All rows and other columns stay; a column that is called ``ids`` is replaced.
    """
    vocab = documents.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(path)))
    kept = [c for c in documents.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part in slices(batch, text, BATCH_BYTES):
                flat, lengths = encode_texts(strings_of(part.column(text)), Vocabulary(*vocab.value))
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, arrays], [*kept, ids])

    schema = documents.select(kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    return documents.select(kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters.

    A null array is an empty one. Ids outside the vocabulary have no text.
    """
    vocab = encoded.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(path)))
    kept = [c for c in encoded.columns if c != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*vocab.value)
        starts, sizes = own.offsets[:-1], np.diff(own.offsets)
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            give_back()
            for part in _parts(batch, counts * 8):
                lists = part.column(ids)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = (flat >= 0) & (flat < len(sizes))
                flat = np.where(known, flat, 0)
                size = np.where(known, sizes[flat], 0)
                data = own.data[ragged(starts[flat], size)]
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
                raw = pa.Array.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]
                )
                try:
                    texts = raw.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, texts], [*kept, decoded])

    return encoded.select(kept).mapInArrow(run, encoded.select(kept).schema.add(decoded, "string"))


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Token count and the digests of ids and decoded text, one row per document."""
    coded = decode(encode(documents.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())
