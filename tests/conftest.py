"""Fixtures shared by all tests: one session, driver tables, and the comparison with DuckDB."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = os.environ.get("LODEGRAPH_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return f"{DATA}/sf0.01"


def same(x):
    """A value as both engines write it: no -0.0, one NaN, floats to ten digits, lists for arrays, dicts for structs."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return [same(y) for y in x]
    if hasattr(x, "asDict"):
        return {k: same(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: same(v) for k, v in x.items()}
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def rows_of(df: DataFrame) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr([same(r[n]) for n in names]) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    names = sorted(columns)
    return names, sorted(repr([same(dict(zip(columns, r))[n]) for n in names]) for r in out.fetchall())
