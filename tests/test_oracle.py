"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import pytest

from conftest import duck_rows, rows_of
from lodegraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    names, got = rows_of(catalog.queries()[name](spark, sf))
    expected_names, expected = duck_rows(catalog.oracle_sql()[name], sf)
    assert names == expected_names
    assert len(got) == len(expected)
    assert got == expected
