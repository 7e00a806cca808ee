"""Helpers that several operators of this package share: Arrow texts, blocks of documents, packed integers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = "\\x20\\x09-\\x0D"


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [t or b"" for t in column.to_pylist()]


def strings_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """The texts of an Arrow column as one array with wide offsets; null counts as empty.

    The array is copied together: Arrow's text functions go wrong on a cast slice whose offsets don't begin at zero.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    whole = pa.concat_arrays([c.cast(pa.large_string()) for c in chunks] or [pa.array([], pa.large_string())])
    return pc.fill_null(whole, "")


def slices(batch: pa.RecordBatch, column: int | str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes of a text column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = np.cumsum(sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z in lower case: their places in the distinct words, how many each
    text has, and the distinct words (binary)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.diff(ends), coded.dictionary.cast(pa.large_binary())


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not taken yet."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the machine: workers live on between tasks, and what they hold on to counts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts (one row to the driver)."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def block_of(doc_id: str, text: str, blocks: int) -> Column:
    """A document's block: a function of its id and text alone, so that a recomputed task finds the same block.

    Documents without an id are spread by their text.
    """
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return F.pmod(key, F.lit(blocks)).cast("int")


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted unsigned values may be given as differences."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, count: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=count * size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(unpack(data, count, np.uint64), dtype=np.uint64)


def bucket_bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits ranges of ascending 64-bit keys begins, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit integers over their whole range (the finalizer of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
