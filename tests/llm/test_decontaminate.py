import random

import numpy as np
import pyarrow as pa
import pytest

from newstape.llm import decontaminate


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            step = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            new.append(max(0, row[j] + step, row[j + 1] + decontaminate.GAP, new[j] + decontaminate.GAP))
        best, row = max(best, *new), new
    return best


def test_alignment_scores():
    draw = np.random.default_rng(1)
    items = [draw.integers(2, 6, draw.integers(1, 25)) for _ in range(60)]
    texts = [draw.integers(2, 6, draw.integers(1, 60)) for _ in range(60)]
    score, begin, end = decontaminate.align(items, texts)
    assert score.tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in zip(items, texts)]
    part, _, _ = decontaminate.align(items, [t[b:e] if e > b else t[:1] * 0 - 1 for t, b, e in zip(texts, begin, end)])
    assert part.tolist() == score.tolist()


WORDS = [f"w{i}" for i in range(2000)]


@pytest.fixture
def texts():
    draw = random.Random(3)
    line = lambda n: [draw.choice(WORDS) for _ in range(n)]
    items = [line(40) for _ in range(20)]
    return draw, line, items


def test_copies_and_edited_copies_are_found(spark, frame, texts):
    draw, line, items = texts
    rows, wanted = [], set()
    for n, item in enumerate(items):
        copy = list(item)
        if n % 4 == 1:  # every seventh word replaced
            copy[::7] = line(len(copy[::7]))
        if n % 4 == 2:  # words left out and put in
            del copy[5], copy[20]
            copy[12:12] = line(2)
        if n % 4 == 3:  # marks and case
            copy = [w.upper() + "," for w in copy]
        rows.append((n, " ".join(line(100) + copy + line(50))))
        wanted.add((n, n))
    rows += [(n, " ".join(line(150))) for n in range(100, 150)]
    rows += [(n, " ".join(line(10) + items[0] + line(5))) for n in range(200, 230)]  # most documents of one item
    rows += [(300, None), (301, ""), (302, " ".join(line(30_000) + items[5])), (303, " ".join(items[1][:10]))]
    wanted |= {(n, 0) for n in range(200, 230)} | {(302, 5)}
    benchmark = spark.createDataFrame([(n, " ".join(i), "x") for n, i in enumerate(items)] + [(98, None, "x"), (99, "two words", "x")], "item_id long, text string, docs string")
    found = decontaminate.contaminated(frame(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and len(found) == len(wanted)
    whole = {r.doc_id: r for r in found}
    assert (whole[0].score, whole[0].begin, whole[0].end) == (1.0, 100, 140)
    clean = decontaminate.clean_documents(frame(rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {n for n, _ in rows} - {n for n, _ in wanted}
    assert clean.columns == frame(rows).columns


def test_every_alignment_that_counts_is_found(spark, frame, texts):
    draw, line, items = texts
    common = WORDS[:12]  # words that all items and documents share
    items = [[draw.choice(common) if draw.random() < 0.4 else w for w in item] for item in items[:8]]
    plain = lambda n: [draw.choice(common) if draw.random() < 0.4 else w for w in line(n)]
    copies = []
    for item in items:
        for step in (2, 3, 4, 5, 6):  # every so manieth word replaced, left out, followed by another
            copies.append([draw.choice(WORDS) if i % step == step - 1 else w for i, w in enumerate(item)])
            copies.append([w for i, w in enumerate(item) if i % step != step - 1])
            copies.append([w for i, x in enumerate(item) for w in [x, *line(int(i % step == 0))]])
        copies.append([w for x in item for w in (x, draw.choice(WORDS))])
    rows = [plain(draw.randrange(130)) + c + plain(draw.randrange(130)) for c in copies]
    rows += [plain(90) for _ in range(20)] + [copies[3]] * 3
    wanted = {}
    for n, words in enumerate(rows):
        for i, item in enumerate(items):
            if (score := smith_waterman(item, words) / (2 * len(item))) >= decontaminate.THRESHOLD:
                wanted[n, i] = score
    assert len(wanted) > 90
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = frame([(n, " ".join(words)) for n, words in enumerate(rows)])
    found = decontaminate.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == wanted and len(found) == len(wanted)


def test_passages_of_long_items(spark, frame, texts):
    draw, line, _ = texts
    items = [line(300), line(200), line(101), line(120)]
    edited = lambda item, step: [draw.choice(WORDS) if i % step == 0 else w for i, w in enumerate(item)]
    parts = [items[0][130:230], items[1][7:97], items[2][40:90], items[0][:50], items[3][-50:], edited(items[0], 3), edited(items[1], 4)]
    parts += [items[1][b : b + 50] for b in range(0, 151, 17)]
    owner = [0, 1, 2, 0, 3, 0, 1] + [1] * len(range(0, 151, 17))
    clean = [items[0][20:50], items[1][60:80], line(100)]
    rows = [(n, line(draw.randrange(200)) + x + line(draw.randrange(200))) for n, x in enumerate(parts + clean)]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(frame([(n, " ".join(x)) for n, x in rows]), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == list(enumerate(owner))
    for r in found:
        assert r.score == smith_waterman(items[r.item_id], rows[r.doc_id][1]) / (2 * len(items[r.item_id]))


def test_rows_without_id_and_repeated_rows(spark, frame, texts):
    _, line, items = texts
    copy = " ".join(items[0])
    benchmark = spark.createDataFrame([(0, copy), (0, copy), (None, copy)], "item_id long, text string")
    docs = frame([(None, copy), (None, "other words here"), (1, copy), (1, copy), (1, "clean text of the same id")])
    assert sorted(r.text for r in decontaminate.clean_documents(docs, benchmark).collect()) == ["clean text of the same id", "other words here"]
    # An item without an id is an item: two texts, found by the item with id 0 and by that without one.
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()), key=str)
    assert found == [(1, 0), (1, None), (None, 0), (None, None)]


def test_items_of_one_id_are_all_looked_for(spark, frame, texts):
    _, line, items = texts
    benchmark = spark.createDataFrame([(7, " ".join(items[0])), (7, " ".join(items[1])), (7, None)], "item_id long, text string")
    docs = frame([(i, " ".join(line(20) + items[i] + line(20))) for i in range(3)])
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()) == [0, 1]
    assert [r.doc_id for r in decontaminate.clean_documents(docs, benchmark).collect()] == [2]


@pytest.mark.parametrize("part", [decontaminate.PART_WORDS, 300])
def test_thin_copies_of_longer_items(spark, frame, texts, monkeypatch, part):
    """Every alignment with items of up to 300 words that counts, however thin, whatever the parts of the benchmark."""
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    draw, line, _ = texts
    common = WORDS[:15]
    plain = lambda n: [draw.choice(common) if draw.random() < 0.4 else w for w in line(n)]
    items = [plain(n) for n in (150, 200, 250, 300, 60, 90)]
    rows = []
    for item in items:
        for step in (2, 3, 4, 7):
            rows.append([draw.choice(WORDS) if i % step == step - 1 else w for i, w in enumerate(item)])
            rows.append([w for i, w in enumerate(item) if i % step != step - 1])
            rows.append([w for i, x in enumerate(item) for w in [x, *line(int(i % step == 0))]])
        rows.append([w for i in range(0, len(item), 10) for w in item[i : i + 5] + line(3)])
    rows = [plain(draw.randrange(200)) + r + plain(draw.randrange(200)) for r in rows] + [plain(500) for _ in range(5)]
    wanted = {}
    for n, words in enumerate(rows):
        for i, item in enumerate(items):
            points = smith_waterman(item, words)
            if points >= min(len(item), 2 * decontaminate.PASSAGE):
                wanted[n, i] = points / (2 * len(item))
    assert len(wanted) > 50
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminated(frame([(n, " ".join(words)) for n, words in enumerate(rows)]), benchmark).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == wanted and len(found) == len(wanted)


def test_frequent_units_seed_nothing_they_need_not(spark, frame, texts):
    """With a benchmark many times as large a text has hardly more pairs to align."""
    draw, line, items = texts
    rows = frame([(i, " ".join(line(300))) for i in range(60)])
    words, counts = decontaminate.plain_words(decontaminate.strings_of(pa.array([r.text for r in rows.collect()])))
    for many in (20, 400):
        bench = spark.createDataFrame([(i, " ".join(line(40))) for i in range(many)], "item_id long, text string")
        (part,) = decontaminate.benchmark_parts(rows, bench, 0.5, 3, 50)
        units = decontaminate.units_of(words, counts)
        pairs = sum(len(decontaminate.candidates(units, counts, decontaminate.Seeds(*s), part)[0]) for s in part.seeds)
        assert pairs <= 0.01 * many * 60 * 4


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame([(1, "some words of text")])
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.clean_documents(docs, none).count() == 1
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).collect() == []
