"""Every registered query that has SQL against it in DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sluicebox.queries import QUERIES
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, con, sf, name):
    assert compare(spark, con, name, sf).startswith("ok ")


def test_every_engine_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry_gives_a_row(spark):
    assert entry(spark).count() == 1
