"""Removal of byte strings that documents share, by column-wise construction of a collection's suffix order.

A byte goes if some string of ``length`` bytes that covers it also starts in a document with a smaller doc_id. Strings
meet by content: the k-gram of smallest hash in a string is its anchor, and neighbouring strings with the same anchor
form one fragment of at most 2 * length - k bytes. Only anchors that several documents have are gone into. The
fragments of a range of anchors, each distinct one with its smallest doc_id, form a collection; its Burrows-Wheeler
transform is built by inserting one symbol of every fragment in each round, from the last symbol to the first. The
transform, the suffixes it stands for and their common prefixes with the neighbour before are a sequential file that
every round reads and writes anew. Neighbours that share ``length`` symbols are equal strings, and the smallest
doc_id among them is what each fragment gets back.

Documents are dealt into blocks of bounded text. A block sends every range its own distinct anchors (then, its distinct
fragments) and is answered in the same order, so a passage that very many documents share travels once from each block.
Exact copies of a document with a smaller doc_id are found by their digest and take no further part.
"""

from __future__ import annotations

import hashlib
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.bpe import ragged
from newstape.llm.common import block_of, bucket_bounds, fresh, give_back, mix, pack, pack_sorted, text_bytes, texts_of, unpack, unpack_sorted

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 2 << 20
#: Text for each range of anchors, in bytes; and for each range of fragments.
ANCHOR_RANGE, FRAGMENT_RANGE = 32 << 20, 8 << 20
#: Fragments whose suffixes are ordered together, about.
COLLECTION = 1 << 11
#: Documents from which on an anchor's strings travel one by one, by their own hash: no task gets all its fragments.
HOT_DOCUMENTS = 1 << 12
#: Tasks that the copies of one text are dealt out to.
SALTS = 16
CHUNK = 1 << 15
NO_ID = np.iinfo(np.int64).max


class Fragments:
    """The fragments of some texts.

    ``begin``, ``count``: place of a fragment's first string in the joined texts, and how many strings it has; ``text``
    and ``key``: its text and anchor. Fragments come in the order of the texts.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, k: int = GRAM):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.length = length
        ends = np.cumsum(self.sizes)
        total = len(self.data)
        begins, anchors, keys = [], [], []
        span = length - k + 1
        for lo in range(0, max(0, total - length + 1), CHUNK):
            hi = min(lo + CHUNK, total - length + 1)
            h = _gram_hashes(self.data[lo : hi + length - 1], k)
            bits = int(len(h)).bit_length()
            low = np.uint64((1 << bits) - 1)
            least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if span > width:
                least = np.minimum(least[: width - span or None], least[span - width :])
            place = (least & low).astype(np.int64)
            change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            begins.append(change + lo)
            anchors.append(place[change] + lo)
            keys.append(mix(h[place[change]]))  # smallest hashes crowd at zero: spread them over the ranges again
        begin = np.concatenate([np.zeros(0, np.int64), *begins])
        anchor = np.concatenate([np.zeros(0, np.int64), *anchors])
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(begin)]
        begin, key = begin[new], key[new]
        end = np.append(begin[1:], max(0, total - length + 1))[: len(begin)]
        # Cut what runs over the end of a text: strings begin at most ``length`` bytes before it.
        text = np.searchsorted(ends, begin, "right")
        last = np.searchsorted(ends, end - 1, "right")
        more = last - text + 1
        source = np.repeat(np.arange(len(begin)), more)
        text = np.repeat(text, more) + np.arange(len(source)) - np.repeat(np.cumsum(more) - more, more)
        begin = np.maximum(begin[source], (ends - self.sizes)[text])
        end = np.minimum(end[source], ends[text] - length + 1)
        kept = end > begin
        self.begin, self.count = begin[kept], (end - begin)[kept]
        self.text, self.key = text[kept], key[source[kept]]

    def shared(self, wanted: np.ndarray) -> Fragments:
        """Only the fragments for which ``wanted`` holds."""
        out = object.__new__(Fragments)
        out.__dict__ = self.__dict__ | {n: getattr(self, n)[wanted] for n in ("begin", "count", "text", "key")}
        return out

    def one_by_one(self, hot: np.ndarray) -> Fragments:
        """Fragments for which ``hot`` holds as single strings with keys of their own."""
        if not hot.any():
            return self
        begin = ragged(self.begin[hot], self.count[hot])
        key = np.repeat(self.key[hot], self.count[hot]) ^ _gram_hashes(self.data, self.length)[begin]
        out = self.shared(~hot)
        out.begin, out.count = np.append(out.begin, begin), np.append(out.count, np.ones(len(begin), np.int64))
        out.text, out.key = np.append(out.text, np.repeat(self.text[hot], self.count[hot])), np.append(out.key, mix(key))
        return out

    def strings(self) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Distinct fragments by anchor: their anchors in order, their bytes, and which one each fragment is."""
        raw = self.data.tobytes()
        seen: dict[bytes, int] = {}
        ends = (self.begin + self.count + self.length - 1).tolist()
        codes = [seen.setdefault(raw[b:e], len(seen)) for b, e in zip(self.begin.tolist(), ends)]
        number = np.array(codes, np.int64)
        keys = np.empty(len(seen), np.uint64)
        keys[number] = self.key  # equal bytes have equal anchors
        ordered = sorted(zip(keys.tolist(), seen, range(len(seen))))
        place = np.empty(len(seen), np.int64)
        place[[i for _, _, i in ordered]] = np.arange(len(seen))
        return np.array([k for k, _, _ in ordered], np.uint64), [s for _, s, _ in ordered], place[number]


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on, by doubling."""
    power, width = np.uint64(0x9E3779B97F4A7C15), 1
    part, out, covered = data.astype(np.uint64) + np.uint64(1), None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if out is None:
                    out, covered = part, width
                else:
                    n = len(data) - covered - width + 1
                    out = out[:n] * power + part[covered : covered + n]
                    covered += width
            width *= 2
            if width > k:
                return mix(out)
            half = width // 2
            part = part[: len(part) - half] * power + part[half:]
            power = power * power


class _Column:
    """A sequential file of one column, read and written as a whole from its begin."""

    def __init__(self, folder: str, name: str, dtype):
        self.path, self.dtype, self.count = os.path.join(folder, name), dtype, 0
        self.file = open(self.path, "w+b")  # noqa: SIM115

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values)
        self.count = len(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype, self.count)

    def drop(self) -> None:
        self.file.close()
        os.remove(self.path)


def smallest_holders(strings: list[bytes], ids: np.ndarray, length: int, folder: str) -> list[np.ndarray]:
    """For each string of ``length`` bytes in each fragment, the smallest id of the fragments that have it.

    Column-wise construction: round j inserts the suffix of length j of every fragment that is as long. A suffix cX
    stands behind the m empty ones, behind all that begin with a smaller symbol, and behind as many that begin with
    c as there are c in the transform before X's place. ``folder`` holds two files that each round reads and writes
    anew: the suffixes in order (fragment, suffix length, symbol before the suffix, 0 for none) and the common prefix
    of each with the one before. Common prefixes count up to ``length``; shorter suffixes can't have that many, so
    they are kept from the round on in which suffixes are that long.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    m, longest = len(strings), int(sizes.max())
    data = np.frombuffer(b"".join(strings), np.uint8)
    used = np.bincount(data, minlength=256) > 0
    codes = np.where(used, np.cumsum(used), 0).astype(np.uint16)  # symbols 1, 2, ... in the order of the bytes
    narrow = np.uint8 if used.sum() < 256 else np.uint16
    matrix = np.zeros((m, longest + 1), np.uint16)  # fragments end in the last column; zero before them
    matrix[np.arange(longest + 1) > longest - sizes[:, None]] = codes[data]
    fragment = np.arange(m, dtype=np.uint64) << np.uint64(32)
    suffixes, prefixes = _Column(folder, "suffixes", np.uint64), _Column(folder, "prefixes", np.uint16)
    suffixes.write(fragment | matrix[:, longest])
    place = np.arange(m)  # of the suffix that each fragment got last
    for j in range(1, longest + 1):
        records = suffixes.read()
        n = len(records)
        symbols = records.view(np.uint16)[::4].astype(narrow)
        order = np.argsort(symbols, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        active = np.flatnonzero(sizes >= j)
        at = m + rank[place[active]] - np.count_nonzero(symbols == 0)
        place[active] = at
        old = np.ones(n + len(active), bool)
        old[at] = False
        merged = np.empty(len(old), np.uint64)
        merged[old] = records
        merged[at] = fragment[active] | np.uint64(j << 16) | matrix[active, longest - j]
        suffixes.write(merged)
        if j >= length:
            common = np.zeros(len(old), np.uint16)
            common[old] = prefixes.read() if j > length else 0
            near = np.concatenate([at, at[at + 1 < len(old)] + 1])
            common[near] = _common(merged, near, matrix, length)
            prefixes.write(common)
    records, common = suffixes.read(), prefixes.read()
    suffixes.drop()
    prefixes.drop()
    owner, size = (records >> np.uint64(32)).astype(np.int64), (records >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
    apart = common < length
    least = np.minimum.reduceat(ids[owner], np.flatnonzero(apart))[np.cumsum(apart) - 1]
    whole = np.flatnonzero(size >= length)
    owner, size = owner[whole], size[whole]
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    out[first[owner] + sizes[owner] - size] = least[whole]
    return np.split(out, first[1:])


def _common(records: np.ndarray, at: np.ndarray, matrix: np.ndarray, length: int) -> np.ndarray:
    """Symbols that the suffixes at these places share with those before them, up to ``length``."""
    out = np.zeros(len(at), np.uint16)
    size = records.view(np.uint16)[1::4]
    both = np.flatnonzero((at > 0) & (size[at] >= length) & (size[at - 1] >= length))
    windows = np.lib.stride_tricks.sliding_window_view(matrix, length, axis=1)
    for lo in range(0, len(both), 1 << 14):
        part = at[both[lo : lo + (1 << 14)]]
        owner = records.view(np.uint32)[1::2]
        x = windows[owner[part], matrix.shape[1] - size[part].astype(np.int64)]
        y = windows[owner[part - 1], matrix.shape[1] - size[part - 1].astype(np.int64)]
        differ = x != y
        out[both[lo : lo + (1 << 14)]] = np.where(differ.any(1), differ.argmax(1), length)
    return out


def _live(table: pa.Table, notes: list[dict]) -> tuple[list[int], list[bytes], np.ndarray]:
    """Rows of a block by id, their texts (empty for copies of a smaller document), and which rows are copies."""
    copies = {(r["id"], r["text_key"]) for r in notes if r["bucket"] is None}
    ids, keys = table["id"].to_pylist(), table["text_key"].to_pylist()
    copy = np.array([(i, k) in copies for i, k in zip(ids, keys)], bool)
    texts = [b"" if c else t for t, c in zip(texts_of(table["text"]), copy.tolist())]
    return ids, texts, copy


_NOTE = "block int, bucket int, id long, text_key long, kind int, n int, data binary"


def _anchors(bits: int, length: int):
    schema = "bucket int, block int, n int, keys binary, docs binary"

    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        give_back()
        _, texts, _ = _live(table, notes.to_pylist())
        found = Fragments(texts, length)
        order = np.lexsort((found.text, found.key))
        key, text = found.key[order], found.text[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        another = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])[: len(key)]
        keys = key[first]
        docs = np.bincount((np.cumsum(first) - 1)[another], minlength=len(keys)).astype(np.uint32)
        block, edges = table["block"][0].as_py() if table.num_rows else 0, bucket_bounds(keys, bits)
        rows = [
            (b, block, int(hi - lo), pack_sorted(keys[lo:hi]), pack(docs[lo:hi]))
            for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
            if hi > lo
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        names = ("bucket", "block", "n", "keys", "docs")
        return pa.table({m: pa.array([r[i] for r in rows], k) for i, (m, k) in enumerate(zip(names, kinds))})

    return run, schema


def _notes(blocks: list[int], buckets: list[int], kind: int, counts: list[int], data: list[bytes]) -> pa.Table:
    n = len(blocks)
    return pa.table(
        {
            "block": pa.array(blocks, pa.int32()), "bucket": pa.array(buckets, pa.int32()),
            "id": pa.nulls(n, pa.int64()), "text_key": pa.nulls(n, pa.int64()),
            "kind": pa.array([kind] * n, pa.int32()), "n": pa.array(counts, pa.int32()), "data": pa.array(data, pa.binary()),
        }
    )


def _shared_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For each anchor of each block whether one document has it (0), several (1), or very many (2)."""
        give_back()
        rows = table.to_pylist()
        keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
        docs = np.concatenate([unpack(r["docs"], r["n"], np.uint32) for r in rows])
        order = np.argsort(keys).astype(np.uint32)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        del keys
        total = np.add.reduceat(docs[order].astype(np.int64), first)
        kind = np.empty(len(order), np.uint8)
        kind[order] = np.repeat((total > 1).astype(np.uint8) + (total >= hot), np.diff(first, append=len(order)))
        ends = np.cumsum([r["n"] for r in rows])
        data = [pack(kind[e - r["n"] : e]) for r, e in zip(rows, ends)]
        return _notes([r["block"] for r in rows], [r["bucket"] for r in rows], 1, [r["n"] for r in rows], data)

    return run


def _kept(found: Fragments, notes: list[dict]) -> Fragments:
    """The fragments whose anchors several documents have; strings one by one where very many have it."""
    rows = sorted((r for r in notes if r["kind"] == 1), key=lambda r: r["bucket"])
    kinds = np.concatenate([np.zeros(0, np.uint8), *(unpack(r["data"], r["n"], np.uint8) for r in rows)])
    order = np.argsort(found.key)
    ascending = found.key[order]
    kind = np.zeros(len(order), np.uint8)
    if len(kinds):
        kind[order] = kinds[np.concatenate([[0], np.cumsum(ascending[1:] != ascending[:-1])])]
    return found.shared(kind > 0).one_by_one(kind[kind > 0] > 1)


def _fragments(bits: int, length: int):
    schema = "bucket int, block int, n int, keys binary, sizes binary, ids binary, size int, data binary"

    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        give_back()
        rows = notes.to_pylist()
        ids, texts, _ = _live(table, rows)
        found = _kept(Fragments(texts, length), rows)
        keys, strings, number = found.strings()
        least = np.full(len(strings), NO_ID)
        np.minimum.at(least, number, np.array(ids, np.int64)[found.text])
        block, edges = table["block"][0].as_py() if table.num_rows else 0, bucket_bounds(keys, bits)
        out = []
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if hi > lo:
                data = b"".join(strings[lo:hi])
                sizes = np.array([len(s) for s in strings[lo:hi]], np.uint16)
                packed = pa.compress(data, codec="zstd", asbytes=True)
                out.append((b, block, int(hi - lo), pack_sorted(keys[lo:hi]), pack(sizes), pack(least[lo:hi]), len(data), packed))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        names = ("bucket", "block", "n", "keys", "sizes", "ids", "size", "data")
        return pa.table({m: pa.array([r[i] for r in out], k) for i, (m, k) in enumerate(zip(names, kinds))})

    return run, schema


def _holders(length: int):
    def run(table: pa.Table) -> pa.Table:
        """For each fragment of each block how the smallest holder of each of its strings differs from its own."""
        give_back()
        seen: dict[bytes, int] = {}
        rows = table.to_pylist()
        numbers, ids, keys = [], [], []
        for r in rows:
            sizes = unpack(r["sizes"], r["n"], np.uint16)
            raw = pa.decompress(r["data"], decompressed_size=r["size"], codec="zstd", asbytes=True)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            numbers.append(np.array([seen.setdefault(raw[b:e], len(seen)) for b, e in zip([0, *ends[:-1]], ends)], np.int64))
            ids.append(unpack(r["ids"], r["n"], np.int64))
            keys.append(unpack_sorted(r["keys"], r["n"]))
        least = np.full(len(seen), NO_ID)
        np.minimum.at(least, np.concatenate(numbers), np.concatenate(ids))
        key = np.empty(len(seen), np.uint64)
        key[np.concatenate(numbers)] = np.concatenate(keys)  # equal bytes have equal anchors
        strings = list(seen)
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(step) - 1
        alone = (np.bincount(group) == 1)[group]
        # An anchor with one distinct fragment has nothing to compare: all who hold it hold the same strings.
        answers = [np.full(len(s) - length + 1, low) if one else None for s, low, one in zip(strings, least.tolist(), alone.tolist())]
        order = order[~alone[order]].tolist()
        with tempfile.TemporaryDirectory() as folder:
            lo = 0
            while lo < len(order):
                hi = min(lo + COLLECTION, len(order))
                while hi < len(order) and group[order[hi]] == group[order[hi - 1]]:
                    hi += 1
                part = order[lo:hi]
                for i, holders in zip(part, smallest_holders([strings[i] for i in part], least[part], length, folder)):
                    answers[i] = holders
                lo = hi
        data, sizes = [], []
        for number, own in zip(numbers, ids):
            found = np.concatenate([answers[i] for i in number.tolist()])
            counts = np.array([len(answers[i]) for i in number.tolist()], np.int64)
            data.append(pack(found - np.repeat(own, counts)))
            sizes.append(len(found))
        return _notes([r["block"] for r in rows], [r["bucket"] for r in rows], 2, sizes, data)

    return run


def _judged(table: pa.Table, notes: list[dict], length: int) -> list[tuple[bytes, int, int, bytes]]:
    """For each row of a block: its text, how many bytes go, in how many runs, and what is left."""
    ids, texts, copy = _live(table, notes)
    whole = texts_of(table["text"])
    found = _kept(Fragments(texts, length), notes)
    _, strings, number = found.strings()
    counts = np.array([len(s) - length + 1 for s in strings], np.int64)
    first = np.cumsum(counts) - counts
    least = np.full(len(strings), NO_ID)
    order = np.array(ids, np.int64)
    np.minimum.at(least, number, order[found.text])
    parts = sorted((r for r in notes if r["kind"] == 2), key=lambda r: r["bucket"])
    holders = np.concatenate([np.zeros(0, np.int64), *(unpack(r["data"], r["n"], np.int64) for r in parts)])
    holders = holders + np.repeat(least, counts)
    at = ragged(found.begin, found.count)
    smaller = holders[ragged(first[number], found.count)] < np.repeat(order[found.text], found.count)
    total = len(found.data)
    begins = np.zeros(total + 1, bool)
    begins[at[smaller]] = True
    begun = np.cumsum(begins, dtype=np.int32)[:total]
    gone = begun > np.concatenate([np.zeros(min(length, total), np.int32), begun[: max(total - length, 0)]])
    out, lo = [], 0
    for i, text in enumerate(whole):
        if copy[i] and len(text) >= length:
            out.append((text, len(text), 1, b""))
            continue
        own = gone[lo : lo + len(texts[i])]
        lo += len(texts[i])
        removed = int(own.sum())
        spans = int(np.count_nonzero(np.diff(own.astype(np.int8), prepend=0) == 1))
        out.append((text, removed, spans, np.frombuffer(text, np.uint8)[~own].tobytes() if removed else text))
    return out


def _results(length: int):
    schema = (
        "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"
    )

    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        give_back()
        out = []
        for text, removed, spans, kept in _judged(table, notes.to_pylist(), length):
            changed = (kept, kept.decode("utf-8", "ignore")) if removed else (None, None)
            out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *changed))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")
        results = {m: pa.array([r[i] for r in out], k) for i, (m, k) in enumerate(zip(names, kinds))}
        return pa.table({"doc_id": table["doc_id"], "text_key": table["text_key"], **results})

    return run, schema


def _trimmed(length: int):
    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        give_back()
        judged = _judged(table, notes.to_pylist(), length)
        rows = [i for i, (text, removed, _, _) in enumerate(judged) if not removed or removed < len(text)]
        texts = [judged[i][3].decode("utf-8", "ignore") for i in rows]
        changed = [judged[i][1] > 0 for i in rows]
        rest = table["rest"].take(pa.array(rows, pa.int64()))
        return pa.table({"rest": rest, "text": pa.array(texts, pa.string()), "changed": pa.array(changed, pa.bool_())})

    return run


def dedup(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, kept, kept_text) of each row of ``documents``
    (doc_id, text).

    Texts count as UTF-8 bytes, a null one as empty; ``n_spans`` is the number of maximal removed runs. Where something
    is removed, ``kept`` has the remaining bytes and ``kept_text`` their whole characters; else both are null. Strings
    never cross documents and are judged on the input. Rows without a doc_id come after all others; rows that share a
    doc_id, or have none, take nothing from each other. ``text_key`` is the text's XXH64, to tell such rows apart.
    Other columns are ignored; repeated rows stay.
    """
    results, schema = _results(length)
    by_block, notes = _answered(documents, length, [])
    return by_block.cogroup(notes.groupBy("block")).applyInArrow(results, schema)


def _answered(documents: DataFrame, length: int, rest: list):
    """The documents by block, with ``rest`` beside them, and what the corpus answers each block."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *rest)
    size = text_bytes(docs)
    blocks = max(1, -(-size // BLOCK_BYTES))
    ranges = [max(0, math.ceil(math.log2(max(1, size / r)))) for r in (ANCHOR_RANGE, FRAGMENT_RANGE)]
    dealt = docs.select(
        "doc_id", "text", block_of("doc_id", "text", blocks).alias("block"), F.xxhash64("text").alias("text_key"),
        F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), *(["rest"] if rest else []),
    )
    own = [F.col(c).alias(c) for c in ("block", "id", "text_key")]
    digests = dealt.select(*own, F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # A text that a third of all documents repeat would meet its first in one task: both sides are salted.
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("id", "block"), F.lit(SALTS)))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    copies = salted.join(firsts, ["digest", "salt"]).where("id > first")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("n", "int"), ("data", "binary"))]
    copies = copies.select("block", F.lit(None).cast("int").alias("bucket"), "id", "text_key", *nothing)

    anchors, anchor_schema = _anchors(ranges[0], length)
    fragments, fragment_schema = _fragments(ranges[1], length)
    by_block = dealt.groupBy("block")
    shared = by_block.cogroup(copies.groupBy("block")).applyInArrow(anchors, anchor_schema)
    shared = copies.unionByName(shared.groupBy("bucket").applyInArrow(_shared_anchors(HOT_DOCUMENTS), _NOTE))
    held = by_block.cogroup(shared.groupBy("block")).applyInArrow(fragments, fragment_schema)
    # As many partitions as the session asks for: merged by size, small requests would still be much work for a task.
    held = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    held = held.groupBy("bucket").applyInArrow(_holders(length), _NOTE)
    return by_block, shared.unionByName(held)


def trimmed(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with the remaining text in ``text`` and its characters in ``n_chars``, if there is that column.

    What is left of a cut character goes. Documents that lose their whole text go; empty ones stay. Rows whose text
    loses nothing stay as they are, and so do all other columns; they travel with the text, so no join follows.
    """
    others, missing = [c for c in documents.columns if c != "text"], fresh("_missing", documents.columns)
    rest = F.struct(*[F.col(c) for c in others], F.col("text").isNull().alias(missing)).alias("rest")
    by_block, notes = _answered(documents, length, [rest])
    shape = documents.select(rest).schema.add("text", "string").add("changed", "boolean")
    found = by_block.cogroup(notes.groupBy("block")).applyInArrow(_trimmed(length), shape)
    new = {c: F.col("rest")[c] for c in others} | {"text": F.when(~F.col("rest")[missing], F.col("text"))}
    if "n_chars" in others:
        new["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(new["n_chars"]).cast("long")
    return found.select([new[c].alias(c) for c in documents.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to documents with smaller ids."""
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
