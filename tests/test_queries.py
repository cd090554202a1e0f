"""Every catalog query runs and, where it has SQL, gives the SQL's rows."""

from __future__ import annotations

import oracle
import pytest

from footfall.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, con, name):
    oracle.assert_same(QUERIES[name](spark, sf_dir), SQL[name], con)


def test_others_run(spark, sf_dir):
    """Queries without SQL; at present there are none, which would count as a skipped test."""
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf_dir).count() > 0, name
