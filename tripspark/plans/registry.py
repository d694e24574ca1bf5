"""Names of the registered queries and their SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Modules whose queries are registered on import.
MODULES = ("core", "drive_queries", "scalar_queries", "charging_queries", "join_queries", "import_queries", "listing_queries", "file_queries", "stream_queries")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB text."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _load() -> None:
    for module in MODULES:
        if importlib.util.find_spec(f"tripspark.plans.{module}"):
            importlib.import_module(f"tripspark.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
