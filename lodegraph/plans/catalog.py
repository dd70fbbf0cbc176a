"""The registry of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lodegraph.plans.registry import QUERIES, SQL

for _name in ("graph_queries", "text_queries", "retrieval_queries", "knowledge_queries", "store_queries", "event_queries", "code_queries", "lifecycle_queries"):
    import_module(f"lodegraph.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
