"""Every registered query equals its SQL on the small tables."""

import pytest

from loglantern.checks.compare import compare, duck
from loglantern.checks.queries import QUERIES
from loglantern.checks.reference_sql import SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, QUERIES[name], SQL[name])
    assert ok, note
