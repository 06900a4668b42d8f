"""Every query of the engine against its SQL; queries without SQL give rows and a stable schema."""

import pytest

from recallix import catalog

from .compare import database, difference

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.columns and df.count() >= 0
