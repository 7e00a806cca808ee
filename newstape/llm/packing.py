"""Token ids packed into rows of one length, written as binary matrices.

Documents longer than a row are cut into whole rows and a rest; nothing is lost. Rests and shorter documents are packed
best fit decreasing: the longest first, each into the open row with the least room that still holds it. A segment
tree over the amounts of free room finds that row in the logarithm of the row's length. Documents are packed in blocks of
bounded text, so a task holds one block, and a row never mixes blocks.

A row is stored as little-endian ids (padded at its end), the cumulative lengths of its segments, and the places where
positions start again from zero, which are the segments' begins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.bpe import Vocabulary, encode_texts, load_vocabulary, public_vocabulary, ragged
from newstape.llm.common import block_of, slices, strings_of, text_bytes
from newstape.llm.warc import new_folder

#: Tokens of a row; text of a block in bytes.
CONTEXT, BLOCK_BYTES = 4096, 8 << 20
#: Text bytes that are encoded together: a block, but for very long texts.
BATCH_BYTES = 8 << 20
#: Byte-level ids: the bytes of the text, then an end.
END_ID, PAD_ID = 256, 257


class FreeRoom:
    """Rows by free room: a segment tree of how many open rows have each amount."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = self.leaves + room
        while node:
            self.tree[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Takes out the row with the least room of at least ``size``: its room and number."""
        tree, node = self.tree, self.leaves + size
        if size >= len(self.rows):
            return None
        while not tree[node]:
            while node & 1:  # a right child: go up
                node >>= 1
                if node <= 1:
                    return None
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not tree[node]:
                node += 1
        room = node - self.leaves
        while node:
            tree[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, context: int) -> tuple[np.ndarray, int]:
    """The row of each segment (none longer than ``context``) and the number of rows; ties in the order given."""
    row_of, rows, free = np.zeros(len(sizes), np.int64), 0, FreeRoom(context)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = free.take(size)
        if found is None:
            found, rows = (context, rows), rows + 1
        room, row = found
        row_of[i] = row
        if room > size:
            free.add(room - size, row)
    return row_of, rows


def byte_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte-level ids of all texts in a row, each text followed by its end, and how many each has."""
    raw = texts.cast(pa.large_binary())
    sizes = np.array([len(t) for t in raw.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    counts = sizes + 1
    ids = np.full(int(counts.sum()), END_ID, np.uint16)
    ids[ragged(np.cumsum(counts) - counts, sizes)] = data
    return ids, counts


def bpe_ids(spark: SparkSession, path: str, end: str = "<|endoftext|>") -> tuple[Callable, int, str]:
    """A ``tokenize`` for ``pack`` that gives the ids of a vocabulary file, each text followed by the id of ``end``,
    with a padding id (the first that the vocabulary does not use) and the type that holds them.

    The spelling of ``end`` inside a text is that id too, as the tokenizer has it. The vocabulary travels with the tasks:
    its size is that of the file.
    """
    loaded = load_vocabulary(path)
    vocab, pad_id = spark.sparkContext.broadcast(tuple(loaded)), len(loaded.offsets) - 1

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = Vocabulary(*vocab.value)
        done = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for part in slices(pa.record_batch([texts], ["text"]), "text", BATCH_BYTES):
            done.append(encode_texts(strings_of(part.column("text")), own))
        lengths = np.concatenate([n for _, n in done])
        counts = lengths + 1
        ids = np.full(int(counts.sum()), own.special[end], np.int32)
        ids[ragged(np.cumsum(counts) - counts, lengths)] = np.concatenate([flat for flat, _ in done])
        return ids, counts

    return run, pad_id, "uint16" if pad_id < 1 << 16 else "uint32"


ROW = (
    "block int, row int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, pieces array<int>"
)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _pack(context: int, tokenize: Callable, pad_id: int, dtype: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        ids, counts = tokenize(strings_of(table["text"]))
        pieces = np.maximum(-(-counts // context), 1)
        doc = np.repeat(np.arange(len(counts)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(counts) - counts)[doc] + number * context
        size = np.minimum(counts[doc] - number * context, context)
        row_of, rows = best_fit_decreasing(size, context)
        order = np.argsort(row_of, kind="stable")
        row, begin, size = row_of[order], begin[order], size[order]
        before = np.cumsum(size) - size
        first = np.searchsorted(row, np.arange(rows))
        at = before - before[first][row] if rows else before
        matrix = np.full(rows * context, pad_id, dtype)
        matrix[ragged(row * context + at, size)] = ids[ragged(begin, size)]
        segments = np.bincount(row, minlength=rows)
        ends = np.cumsum(segments)
        lengths = np.insert(at + size, first, 0)  # every row's list begins with zero
        raw = matrix.astype(np.dtype(dtype).newbyteorder("<")).tobytes()
        width = context * np.dtype(dtype).itemsize
        return pa.table(
            {
                "block": pa.array(np.full(rows, table["block"][0].as_py()), pa.int32()), "row": pa.array(np.arange(rows), pa.int32()),
                "ids": pa.array([raw[i * width : (i + 1) * width] for i in range(rows)], pa.binary()),
                "n_tokens": pa.array(np.bincount(row, weights=size, minlength=rows).astype(np.int32)),
                "cu_seqlens": _lists(lengths.astype(np.int32), ends + np.arange(1, rows + 1)),
                "position_resets": _lists(at.astype(np.int32), ends),
                "doc_ids": pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), table["doc_id"].combine_chunks().take(pa.array(doc[order]))
                ),
                "pieces": _lists(number[order].astype(np.int32), ends),
            }
        )

    return run


def pack(
    documents: DataFrame,
    context: int = CONTEXT,
    tokenize: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = byte_ids,
    pad_id: int = PAD_ID,
    dtype: str = "uint16",
) -> DataFrame:
    """Rows of ``context`` ids from ``documents`` (doc_id, text); see ``ROW``.

    ``tokenize`` gives the ids of an array of texts, one after the other, and the count of each; ``dtype`` holds them
    and ``pad_id``. ``doc_ids`` and ``pieces`` name each segment's document and which piece of it this is, from 0. Null
    texts are empty, and an empty text is one segment (with byte ids: its end alone). Rows without a doc_id and
    repeated rows are packed like any other; other columns are ignored. Without documents there is no row.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    dealt = docs.withColumn("block", block_of("doc_id", "text", blocks))
    return dealt.groupBy("block").applyInArrow(_pack(context, tokenize, pad_id, dtype), ROW)


def write_packed(packed: DataFrame, folder: str) -> DataFrame:
    """Writes the rows below ``folder`` and reads them back."""
    packed.write.option("compression", "zstd").parquet(folder)
    return packed.sparkSession.read.schema(ROW).parquet(folder)


def positions_of(cu_seqlens: np.ndarray, context: int) -> np.ndarray:
    """Positions of a row's tokens: from zero in each segment; zero in the padding."""
    out = np.zeros(context, np.int64)
    for lo, hi in zip(cu_seqlens[:-1], cu_seqlens[1:]):
        out[lo:hi] = np.arange(hi - lo)
    return out


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed as token ids of a public vocabulary, written, and read back: one row for each packed row."""
    tokenize, pad_id, dtype = bpe_ids(spark, public_vocabulary())
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenize=tokenize, pad_id=pad_id, dtype=dtype)
    stored = write_packed(packed, new_folder(spark, "packed"))
    return stored.select(
        "block", "row", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces", F.sha2("ids", 256).alias("ids_sha256")
    )
