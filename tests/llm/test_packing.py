import random

import numpy as np
import pyarrow as pa
import pytest

from newstape.llm import packing


def naive(sizes, context):
    free, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in range(len(free)) if free[r] >= sizes[i]]
        best = min(fits, key=free.__getitem__) if fits else len(free)
        if not fits:
            free.append(context)
        free[best] -= sizes[i]
        out[i] = best
    return free


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_decreasing(seed):
    draw = random.Random(seed)
    context = draw.randrange(1, 50)
    sizes = np.array([draw.randrange(1, context + 1) for _ in range(draw.randrange(80))], np.int64)
    rows, count = packing.best_fit_decreasing(sizes, context)
    used = np.bincount(rows, weights=sizes, minlength=count) if count else np.zeros(0)
    assert sorted((context - used).astype(int).tolist()) == sorted(int(f) for f in naive(sizes.tolist(), context))


def restored(rows, context, dtype="<u2"):
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype)
        assert len(ids) == context and r.n_tokens == r.cu_seqlens[-1] <= context
        assert r.cu_seqlens[0] == 0 and list(r.position_resets) == list(r.cu_seqlens[:-1])
        assert (ids[r.n_tokens :] == packing.PAD_ID).all()
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            pieces.setdefault(doc, {}).setdefault(piece, []).append(ids[lo:hi].tolist())
    return pieces


def test_nothing_is_lost(spark, frame, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 3000)
    draw = random.Random(1)
    rows = [(i, "é" * draw.randrange(0, 120)) for i in range(80)] + [(90, None), (91, ""), (92, "x" * 5000), (None, "none")]
    stored = packing.write_packed(packing.pack(frame(rows), context=64), str(tmp_path / "packed")).collect()
    assert len({(r.block, r.row) for r in stored}) == len(stored)
    pieces = restored(stored, 64)
    assert set(pieces) == {i for i, _ in rows}
    for doc, text in rows:
        parts = [pieces[doc][n] for n in range(len(pieces[doc]))]
        assert all(len(p) == 1 for p in parts) and all(len(p[0]) == 64 for p in parts[:-1])
        ids = [x for p in parts for x in p[0]]
        assert ids == [*(text or "").encode(), packing.END_ID]


def test_rows_are_well_filled(frame):
    draw = random.Random(2)
    rows = packing.pack(frame([(i, "x" * draw.randrange(1, 300)) for i in range(400)]), context=256).collect()
    assert sum(r.n_tokens for r in rows) > 0.97 * 256 * len(rows)


def test_repeated_rows_and_none(frame):
    found = packing.pack(frame([(1, "ab"), (1, "ab")]), context=8).collect()
    assert [list(r.doc_ids) for r in found] == [[1, 1]]
    assert packing.pack(frame([]).limit(0)).collect() == []


def test_positions_start_again():
    assert packing.positions_of(np.array([0, 3, 5]), 8).tolist() == [0, 1, 2, 0, 1, 0, 0, 0]


def test_byte_ids():
    ids, counts = packing.byte_ids(pa.array(["a", "", "é"], pa.large_string()))
    assert counts.tolist() == [2, 1, 3] and ids.tolist() == [97, 256, 256, 0xC3, 0xA9, 256]


def test_token_ids_of_a_vocabulary(spark, frame, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(packing, "BLOCK_BYTES", 400)
    monkeypatch.setattr(packing, "BATCH_BYTES", 50)
    path = packing.public_vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [None, "", "two  spaces, Ärger and 日本", "x<|endoftext|>y", *(f"word {i} " * i for i in range(30)), "long " * 300]
    tokenize, pad_id, dtype = packing.bpe_ids(spark, path)
    assert (pad_id, dtype) == (50257, "uint16")
    stored = packing.pack(frame(list(enumerate(texts))), 64, tokenize, pad_id, dtype).collect()
    pieces = {}
    for r in stored:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and (ids[r.n_tokens :] == pad_id).all() and (ids[: r.n_tokens] < pad_id).all()
        for doc, piece, lo, hi in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            pieces[doc, piece] = ids[lo:hi].tolist()
    for doc, text in enumerate(texts):
        own = [pieces[key] for key in sorted(k for k in pieces if k[0] == doc)]
        assert [x for p in own for x in p] == [*library.encode(text or "", add_special_tokens=False).ids, 50256]
