"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from siltline.plans import catalog

from .compare import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).count() == 20
