"""Queries of the corpus operators: those with SQL give DuckDB's rows; all give a row or more."""

from __future__ import annotations

import pytest

from conftest import duck_rows, rows_of
from lodegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    names, got = rows_of(queries.queries()[name](spark, sf))
    expected_names, expected = duck_rows(queries.oracle_sql()[name], sf)
    assert names == expected_names
    assert got == expected
