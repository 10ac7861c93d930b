import pytest

from runeflow.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_is_its_sql_twin(spark, name):
    d = "/root/testdata/sf0.001"
    compare(spark, connect(d), queries.QUERIES[name], queries.ORACLE[name], d)
