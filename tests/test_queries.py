"""Every registered query against its SQL counterpart, or at least for rows, on the smallest tables."""

import pytest

from tabloom.plans import catalog
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, folder, con, name):
    assert compare(catalog.QUERIES[name](spark, folder), con, catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
