"""Every reference query against its SQL."""

from __future__ import annotations

import pytest
from duck import connect, rows_of, sql_rows

from findweave.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert rows_of(catalog.QUERIES[name](spark, sf_dir)) == sql_rows(con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
