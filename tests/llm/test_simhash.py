import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from newstape.llm import simhash
from newstape.llm.components import components


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, max_bits=4):
    prints = [fingerprint(t) for _, t in rows]
    out = []
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            a = todo.pop()
            more = [b for b in range(len(rows)) if b not in reached and (prints[a] ^ prints[b]).bit_count() <= max_bits]
            reached.update(more)
            todo.extend(more)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        out.append((rows[i][0], prints[i], min(ids, default=None)))
    return sorted(out, key=str)


def near_copies(draw):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randrange(60, 150))]
        for _ in range(draw.randrange(1, 5)):
            copy = list(base)
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy))
    return rows


def test_components_equal_brute_force(frame):
    texts = near_copies(random.Random(4))
    texts += [None, "", " \n", "one", "One", "one two three", "É one", "a " * 20_000, texts[0].upper(), texts[0], texts[0]]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "lone words without id"), (100, texts[3])]
    found = simhash.near_duplicates(frame(rows)).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == brute(rows)


def test_one_document_of_each_group_stays(frame):
    texts = near_copies(random.Random(5))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = frame(rows)
    kept = simhash.keep_one(docs)
    least = {c for _, _, c in brute(rows)}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*least, *([3] if 3 in least else [])])


@pytest.mark.parametrize("segments, bits", [(1, 2), (2, 4), (3, 4), (4, 4), (5, 4), (3, 0)])
def test_links_lose_no_pair(spark, segments, bits):
    draw = random.Random(segments)
    prints = {0, (1 << 64) - 1, 1 << 63}
    while len(prints) < 150:
        base = draw.getrandbits(64)
        prints.add(base)
        for _ in range(4):
            prints.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 7))))
    signed = [p - (p >> 63 << 64) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {frozenset(r) for r in simhash.links(nodes, bits, segments).collect()}
    wanted = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= bits}
    assert got == wanted


def test_no_documents(frame):
    assert simhash.near_duplicates(frame([]).limit(0)).collect() == []


def test_batches_equal_single_texts():
    texts = ["", "a b", "x y z q r s t", "", "A B"]
    found = simhash.fingerprints(pa.array(texts, pa.large_string()))
    assert found.dtype == np.uint64 and found.tolist() == [fingerprint(t) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    draw = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(5, 5), (7, 3), (3, 7), (3, 7)]
    links += [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
