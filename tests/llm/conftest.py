import pytest
from pyspark import cloudpickle

import newstape

cloudpickle.register_pickle_by_value(newstape)

DOCS = "doc_id long, text string, lang string, n_chars long, block int, fp string, kept string, _key long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as documents with further columns, some of them named like an operator's own."""

    def make(rows, extra=True, parts=3):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        full = [(i, t, "en", None if t is None else len(t), 7, "x", "y", 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def vocabulary():
    from newstape.llm import bpe

    return bpe.public_vocabulary()
