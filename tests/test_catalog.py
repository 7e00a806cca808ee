import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

SQLS = entry.oracle_sql()
SLOW = {"crossval", "feature_importance", "compare_models", "train_rf", "train_gbt", "predict", "backtest_model"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, SQLS[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQLS) - SLOW))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(SQLS) <= set(entry.queries())
