"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules of this package that offer QUERIES (name -> query) and SQL (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("lm_queries", "frame_queries", "text_queries", "metric_queries", "source_queries")


def _merged(attribute: str) -> dict:
    from importlib import import_module

    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), attribute)
    return found


def queries() -> dict[str, Query]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
