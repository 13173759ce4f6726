"""All queries of the core operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_queries", "vector_queries", "graph_queries", "community_queries", "evaluation_queries", "search_queries", "store_queries", "model_queries", "table_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in import_module(f"skein.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(f"skein.plans.{m}").SQL.items()}
