"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
column names equal the oracle's.  Counts are BIGINT and doubles are rounded
to 6 decimals on both sides so the value hashes are comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query and (optionally) its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def oracle_of(name: str) -> str:
    """The SQL of a query registered before, for another way to its rows."""
    return _ORACLES[name]


def _load_all() -> None:
    # Import for side effects: each module registers its queries.
    from . import (  # noqa: F401
        q_changes,
        q_collated,
        q_evaluate,
        q_generate,
        q_metrics,
        q_published,
        q_readability,
        q_streamed,
        q_text,
        q_usage,
    )


def _shipped(fn: QueryFn) -> QueryFn:
    from ..session import ship_package

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    """name -> callable; each call first makes the package importable in the
    Python workers (``ship_package``)."""
    _load_all()
    return {k: _shipped(v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
