import hashlib
import random

import pytest
from pyspark.sql import functions as F

from newstape.llm import fill_middle

ALPHABET = ["a", "é", "日", "🙂", "́", "\n", "<", "P>", "<S", ">", "word "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    t = text or ""
    n = len(t)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(t), sha(t))
    form = "spm" if h4 % 100 < 20 else "psm"
    one, two, three = t[:lo], t[lo:hi], t[hi:]
    out = f"<P>{one}<S>{three}<M>{two}" if form == "psm" else f"<S>{three}<P>{one}<M>{two}"
    return (doc_id, n, form, lo, hi - lo, sha(out), sha(t))


def texts_of(seed, n, most=60):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("units", [1, 2, 3, 7, 1000])
def test_frames_select_and_thaw(units):
    for text in texts_of(units, 60):
        frames = fill_middle.freeze(text, units)
        assert fill_middle.thaw(frames) == text and fill_middle.units_of(frames) == len(text)
        assert fill_middle.digest(frames) == sha(text)
        draw = random.Random(len(text))
        for _ in range(20):
            lo, hi = sorted((draw.randrange(len(text) + 1), draw.randrange(len(text) + 1)))
            part = fill_middle.select(frames, lo, hi)
            assert fill_middle.thaw(part) == text[lo:hi] and fill_middle.units_of(part) == hi - lo


def test_only_cut_frames_are_decompressed(monkeypatch):
    frames = fill_middle.freeze("".join(map(str, range(5000))), 100)
    opened = []
    plain = fill_middle.unpacked
    monkeypatch.setattr(fill_middle, "unpacked", lambda f: opened.append(f) or plain(f))
    got = fill_middle.select(frames, 250, 10_050)
    assert len(opened) == 2 and {f.data for f in got[1:-1]} <= {f.data for f in frames}


@pytest.mark.parametrize("units", [1, 2, 5, 1000])
def test_outputs_restore_whatever_the_frames(units):
    for i, text in enumerate(texts_of(units + 10, 80)):
        if fill_middle.has_marker(text):
            continue
        frames = fill_middle.freeze(text, units)
        for form in ("plain", "psm", "spm"):
            for lo, hi in ((0, 0), (0, len(text)), (len(text) // 3, len(text) // 2)):
                output = fill_middle.arranged(frames, form, lo, hi)
                again = [fill_middle.Frame(f.units, f.data) for f in fill_middle.freeze(fill_middle.thaw(output), units)]
                assert fill_middle.thaw(fill_middle.rebuilt(output, form)) == text, (i, form)
                assert fill_middle.thaw(fill_middle.rebuilt(again, form)) == text, (i, form)


def test_outputs_of_another_form_are_refused():
    with pytest.raises(ValueError):
        fill_middle.rebuilt(fill_middle.freeze("<P>a<S>b"), "psm")


def test_documents(frame):
    rows = list(enumerate(texts_of(1, 400))) + [(1000, None), (1001, ""), (None, "no id"), (5, texts_of(1, 6)[5])]
    rows += [(2000 + i, "é🙂" * 30_000 + str(i)) for i in range(5)] + [(2100 + i, f"a {m} b") for i, m in enumerate(fill_middle.MARKERS)]
    got = [tuple(r) for r in fill_middle.digests(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_stored_texts_transform_and_come_back(frame):
    rows = [(i, t) for i, t in enumerate(texts_of(4, 150))] + [(900, None), (901, "x" * 50_000), (901, "x" * 50_000)]
    docs = frame(rows).withColumnRenamed("fp", "frames").withColumn("form", F.lit("clash"))
    made = fill_middle.transform(fill_middle.store(docs, frame_units=11))
    assert made.columns == [c for c in docs.columns if c not in ("text", "frames", "form")] + ["frames", "n", "form", "prefix_chars", "middle_chars"]
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars) for r in made.collect()]
    assert sorted(got, key=str) == sorted((brute(*r)[:5] for r in rows), key=str)
    back = [(r.doc_id, r.text) for r in fill_middle.restore(made).collect()]
    assert sorted(back) == sorted((i, t or "") for i, t in rows)


def test_no_documents(frame):
    assert fill_middle.digests(frame([]).limit(0)).collect() == []
    assert fill_middle.restore(fill_middle.transform(fill_middle.store(frame([]).limit(0)))).collect() == []
