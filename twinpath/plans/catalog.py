"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
#: Modules that register their queries when they are imported.
MODULES = ("profiles", "sequences", "joins", "scores", "similarities", "contracts", "kernels", "pictures", "stored", "walks")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that gives the same rows in DuckDB, if SQL can."""

    def register(run: Query) -> Query:
        if run.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {run.__name__}")
        _QUERIES[run.__name__] = (run, sql)
        return run

    return register


def _loaded() -> dict[str, tuple[Query, str | None]]:
    for module in MODULES:
        importlib.import_module(f"twinpath.plans.{module}")
    return _QUERIES


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _loaded().items() if sql}
