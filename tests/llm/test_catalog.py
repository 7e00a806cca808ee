import pytest

from newstape.llm import catalog
from tests import oracle


@pytest.fixture(scope="module")
def connection(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert oracle.compare(catalog.QUERIES[name](spark, sf_dir), connection, catalog.ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES) == list(range(1, 14))
