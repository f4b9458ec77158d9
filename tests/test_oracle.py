"""Every registered query agrees with its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from visledger.plans import registry

from .oracle import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
