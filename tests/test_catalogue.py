import pytest

from runeflow.plans import catalogue
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_is_its_sql_twin(spark, db, name):
    compare(spark, db, catalogue.QUERIES[name], catalogue.ORACLE[name], D)


#: The fonts here have no explicit pairs, so their reports are empty.
EMPTY = {"gpos_pairs", "kerning_fonts"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_twin_has_rows(spark, name):
    """What the rows hold is tested in test_font_queries.py and test_operators.py."""
    rows = catalogue.QUERIES[name](spark, D).limit(5).collect()
    assert bool(rows) != (name in EMPTY)
    assert all(any(x is not None for x in r) for r in rows)
