import hashlib
import random

import numpy as np
import pytest

from newstape.llm import suffix_dedup


def brute(rows, length=50):
    first = {}
    big = suffix_dedup.NO_ID
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for j in range(len(t) - length + 1):
            s = t[j : j + length]
            first[s] = min(first.get(s, big), i)
    out = []
    for (key, _), (i, t) in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if first[t[j : j + length]] < i:
                gone[j : j + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((key, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def collection(seed, alphabet):
    draw = random.Random(seed)
    pool = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30, 200))) for _ in range(5)]
    rows = []
    for i in range(30):
        parts = [draw.choice([*pool, "".join(draw.choice(alphabet) for _ in range(draw.randrange(80)))]) for _ in range(draw.randrange(6))]
        rows.append((50 - i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, alphabet", [(1, "abcdefgh "), (2, "ab"), (3, "aaab\x00é\U0001f600")])
def test_results_equal_brute_force(frame, monkeypatch, seed, alphabet):
    for name, value in (("BLOCK_BYTES", 2500), ("ANCHOR_RANGE", 4000), ("FRAGMENT_RANGE", 2000), ("COLLECTION", 8), ("CHUNK", 300), ("HOT_DOCUMENTS", 9)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = collection(seed, alphabet)
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, ""), (504, "x" * 49), (505, "x" * 49), (506, "x" * 5000)]
    rows += [(507, "x" * 60), (508, rows[1][1] + "y" * 70_000 + rows[2][1]), (None, rows[1][1] * 2), (None, rows[1][1] * 2), (50, rows[3][1])]
    got = suffix_dedup.dedup(frame(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text").collect()
    wanted = brute(rows)
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((w[:5] for w in wanted), key=str)
    changed = sorted(((r.doc_id, bytes(r.kept), r.kept_text) for r in got if r.n_removed), key=str)
    assert changed == sorted(((w[0], w[5], w[5].decode("utf-8", "ignore")) for w in wanted if w[2]), key=str)
    assert all(r.kept is None and r.kept_text is None for r in got if not r.n_removed)


def test_smallest_holders(tmp_path):
    draw = random.Random(4)
    strings = sorted({bytes(draw.choice(b"ab") for _ in range(draw.randrange(6, 14))) for _ in range(60)})
    ids = np.array([draw.randrange(1000) for _ in strings])
    wanted = [
        [min(i for t, i in zip(strings, ids.tolist()) if s[j : j + 6] in t) for j in range(len(s) - 5)] for s in strings
    ]
    got = suffix_dedup.smallest_holders(strings, ids, 6, str(tmp_path))
    assert [g.tolist() for g in got] == wanted
    assert not list(tmp_path.iterdir())


def test_trimmed_documents(frame):
    shared = "a passage of well over fifty bytes that three documents hold in common é"
    rows = [(1, "one " + shared), (2, shared + " two"), (3, shared), (4, "plain"), (5, None), (6, ""), (4, "plain"), (7, "x é" + shared)]
    docs = frame(rows)
    kept = suffix_dedup.trimmed(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
    texts = [(1, "one " + shared), (2, " two"), (4, "plain"), (4, "plain"), (5, None), (6, ""), (7, "x é")]
    assert got == sorted(((i, t, None if t is None else len(t)) for i, t in texts), key=str)


def test_no_documents(frame):
    assert suffix_dedup.dedup(frame([]).limit(0)).collect() == []
    assert suffix_dedup.trimmed(frame([]).limit(0)).collect() == []
