"""Every reference query against its SQL."""

from __future__ import annotations

import pytest

import oracle
from ledgerline import queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_same_as_sql(spark, sf, con, name):
    n = oracle.expect_same(queries.queries()[name](spark, sf), con, queries.oracle_sql()[name])
    assert n > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
