"""Every core query against its SQL on the smallest tables; those without SQL must give rows with a stable schema."""

from pathlib import Path

import pytest

from tests.compare import duck, rows_of, rows_of_sql
from lexloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols, rows = rows_of(df)
    if name in SQL:
        other, expected = rows_of_sql(con, SQL[name])
        assert cols == other
        assert rows == expected
    else:
        assert len(set(cols)) == len(cols) and all(len(r) == len(cols) for r in rows)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES
