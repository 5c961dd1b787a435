import importlib.util

import pytest

import __spark_entry__
from purselight import registry
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert ("purselight.llm" in str(importlib.util.find_spec("purselight.llm"))) or all(not k.startswith("op") for k in __spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "customer_id" in df.columns


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
