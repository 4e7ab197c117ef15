"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import differences, engine

from pelagrid.plans.catalogue import QUERIES
from pelagrid.plans.oracle import SQL


@pytest.fixture(scope="module")
def con(folder):
    return engine(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con.sql(SQL[name])) == []
