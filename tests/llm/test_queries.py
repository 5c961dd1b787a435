import pytest

from purselight.llm import queries
from tests.oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)
