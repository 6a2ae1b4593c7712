"""All queries of the library proper, each with the SQL that says the same where SQL can say it.

Every query runs over its whole tables, as sources/adapter.py maps them.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
PARTS = ("ledger_queries", "text_queries", "window_queries", "stream_queries", "upkeep_queries", "function_queries")


def _parts() -> list:
    return [import_module(f"siltstone.plans.{p}") for p in PARTS]


def queries() -> dict[str, Query]:
    return {k: f for p in _parts() for k, f in p.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _parts() for k, s in p.R.sql.items()}
