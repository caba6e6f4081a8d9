"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Every query reads the whole tables; nothing is sampled or capped except
where a limit is the feature itself (top-k reports, previews).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # importing the modules fills the registries
    from fleetlake.plans import queries_medallion  # noqa: F401
    from fleetlake.plans import queries_serving  # noqa: F401
    from fleetlake.plans import queries_datasets  # noqa: F401
    from fleetlake.plans import queries_io  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
