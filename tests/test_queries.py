"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from latticeflow import catalog

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.ORACLES:
        assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], sf) is None
    else:
        assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
