import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from newstape.llm import periodic


def brute_runs(words):
    """All runs by the definition: every stretch is tried with every period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = i - q, end - i + q
            smaller = any(all(words[j] == words[j - p] for j in range(start + p, start + length)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((start, length, q))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, *(hashlib.sha256(x.encode()).hexdigest() for x in (listing, left)))


def noisy_repeats(draw):
    """Words of a small alphabet, with blocks that repeat in whole and in part."""
    words = []
    while len(words) < draw.randrange(1, 90):
        block = [draw.choice("abc") for _ in range(draw.choice([1, 1, 2, 3, 4, 5, 7, 8, 9]))]
        words += block * draw.randrange(1, 7) + block[: draw.randrange(len(block) + 1)]
    return words


def test_runs_equal_those_of_the_definition():
    draw = random.Random(3)
    texts = [noisy_repeats(draw) for _ in range(1500)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab") * 4, list("aab") * 9]
    codes = np.array([ord(w) for t in texts for w in t], np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, lengths, periods = periodic.find_runs(codes, offsets)
    for i, words in enumerate(texts):
        own = (starts >= offsets[i]) & (starts < offsets[i + 1])
        got = [tuple(map(int, r)) for r in zip(starts[own] - offsets[i], lengths[own], periods[own])]
        assert got == brute_runs(words), " ".join(words)


def test_runs_of_periodic_texts_with_two_letters():
    """All texts of ten words from two letters: every overlap of short runs occurs."""
    texts = [[(x >> b) & 1 for b in range(12)] for x in range(1 << 12)]
    offsets = np.arange(0, 12 * (len(texts) + 1), 12)
    starts, lengths, periods = periodic.find_runs(np.array(texts, np.int64).reshape(-1), offsets)
    got = {i: [] for i in range(len(texts))}
    for s, length, q in zip(starts.tolist(), lengths.tolist(), periods.tolist()):
        got[s // 12].append((s % 12, length, q))
    assert all(got[i] == brute_runs(t) for i, t in enumerate(texts))


def test_documents(frame):
    draw = random.Random(8)
    rows = [(i, draw.choice([" ", "\n", "\t ", "  "]).join(noisy_repeats(draw))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, "a b " * 5), (7, rows[7][1]), (1003, "é\x1c   é\x85 É")]
    rows += [(i, " ".join(draw.choice("abcdefgh") for _ in range(60))) for i in range(2000, 2100)]
    got = [tuple(r) for r in periodic.digests(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert any(r[1] for r in got if r[0] and r[0] >= 2000)


def test_long_texts_of_few_words_stay_cheap(frame):
    rows = [(1, "the " * 300_000), (2, "a b c " * 50_000 + "x " + "d " * 50_000)]
    got = {r.doc_id: r for r in periodic.digests(frame(rows)).collect()}
    assert (got[1].n_runs, got[1].length, got[1].period, got[1].exponent_milli) == (1, 300_000, 1, 300_000_000)
    # Both runs have 50,000 periods: the first one counts.
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (2, 0, 150_000, 3)


def test_general_interface_keeps_columns_and_real_outputs(frame):
    docs = frame([(5, "x " + "a b " * 5 + "y"), (6, None), (6, None)])
    out = periodic.find(docs.withColumnRenamed("kept", "runs"))
    assert out.columns == [*(c for c in docs.columns if c != "kept"), "runs", "collapsed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [tuple(r) for r in rows[5].runs] == [(1, 10, 2)] and rows[5].collapsed == "x a b y"
    assert rows[6].runs == [] and rows[6].collapsed == "" and out.count() == 3


def test_no_documents(frame):
    assert periodic.digests(frame([]).limit(0)).collect() == []
    assert periodic.find(frame([]).limit(0)).collect() == []


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    short = [tuple(r) for r in docs.where("length(text) < 3000").collect()]
    ids = {i for i, _ in short}
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, sf_dir).collect() if r.doc_id in ids]
    assert sorted(got) == sorted((brute(i, t) for i, t in short), key=lambda r: r[0]) and len(got) > 20
