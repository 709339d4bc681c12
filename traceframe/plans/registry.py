"""Named queries: a Spark plan plus its DuckDB oracle SQL.

``register(name, sql)`` records a function ``(spark, sf_dir) -> DataFrame``
with its oracle (``None`` when the operator has no SQL form; it is then
checked by golden tests instead). Query modules import this and add to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    from . import q_tokens, q_process, q_monitor, q_traffic, q_sessions, q_correlate, q_misc  # noqa: F401
    q_monitor._register_t2_sql()
    for mod in ("q_traffic", "q_sessions", "q_monitor", "q_correlate", "q_misc"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if mod not in str(exc):
                raise
