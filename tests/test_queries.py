"""Every query with SQL against DuckDB."""

from __future__ import annotations

import pytest
from conftest import same_rows

from tesserine import plans

QUERIES, SQL = plans.load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
