import pytest

from quarrylake.queries import general, reference
from tests.oracle import connect, same

QUERIES = general.QUERIES | reference.QUERIES
ORACLE = general.ORACLE | reference.ORACLE


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in ORACLE:
        same(spark, con, data, QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
