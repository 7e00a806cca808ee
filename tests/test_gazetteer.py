import random

import pytest

from newstape.operators import entities, gazetteer

NAMES = [("St. Louis", "GPE"), ("Yahoo!", "ORG"), ("AT&T", "ORG"), ("New York", "GPE"), ("York", "GPE"), ("Bank of New York Mellon", "ORG"),
         ("of New", "LOC"), ("O'Neil-Ford Inc.", "ORG"), ("...", "ORG"), ("Café Zürich", "ORG")]


def brute(form, forms):
    return [i for i, f in enumerate(forms) if f and f" {f} " in f" {form} "]


def test_automaton_equals_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        forms = [" ".join(draw.choice("abc") for _ in range(draw.randrange(0, 6))) for _ in range(draw.randrange(1, 25))]
        automaton = gazetteer.build(forms)
        for _ in range(10):
            text = " ".join(draw.choice("abcd") for _ in range(draw.randrange(0, 30)))
            assert gazetteer.find(automaton, text) == brute(text, forms)


@pytest.mark.parametrize("most", [gazetteer.AUTOMATON_NAMES, 3])
def test_names_with_marks_nested_and_overlapping(spark, most):
    texts = [
        (1, "He left St. Louis for Yahoo! (and AT&T)."),
        (2, "The Bank of New York Mellon; of New Yorkers"),
        (3, "O'Neil-Ford, Inc. met at Café\tZürich... York"),
        (4, "St Louis... yahoo AT & T"),
        (5, None),
        (6, ""),
    ]
    df = spark.createDataFrame(texts, "doc_id int, headline string")
    names = spark.createDataFrame([*NAMES, (None, "ORG")], "entity string, entity_type string")
    found = entities.gazetteer_entities(df, names, ["doc_id"], "headline", most=most)
    got = {i: {r.entity for r in found.collect() if r.doc_id == i} for i, _ in texts}
    assert got[1] == {"St. Louis", "Yahoo!", "AT&T"}
    assert got[2] == {"Bank of New York Mellon", "New York", "York", "of New"}
    assert got[3] == {"O'Neil-Ford Inc.", "Café Zürich", "York"}
    assert got[4] == {"St. Louis"} and not got[5] and not got[6]


def test_both_ways_agree(spark):
    draw = random.Random(7)
    texts = [(i, " ".join(draw.choice(["a", "b.", "(c", "d", "é!", "&"]) for _ in range(draw.randrange(40)))) for i in range(120)]
    names = [(" ".join(draw.choice(["a", "b", "c,", "d.", "é"]) for _ in range(draw.randrange(1, 5))), draw.choice(["ORG", "GPE"])) for _ in range(60)]
    df = spark.createDataFrame(texts, "doc_id int, headline string")
    table = spark.createDataFrame(names, "entity string, entity_type string").distinct()
    one, two = (
        sorted(tuple(r)[:3] for r in entities.gazetteer_entities(df, table, ["doc_id"], "headline", most=m).distinct().collect())
        for m in (1000, 5)
    )
    assert one == two and one


def test_no_names(spark):
    df = spark.createDataFrame([(1, "cost $5 million")], "doc_id int, headline string")
    empty = spark.createDataFrame([], "entity string, entity_type string")
    assert [r.entity for r in entities.extract_entities(df, gazetteer=empty, keep=()).collect()] == ["$5 million"]
