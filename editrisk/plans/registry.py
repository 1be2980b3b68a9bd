"""Registered queries: one per operator key, each with its DuckDB oracle.

Every query reads the driver's tables (through the stand-in log of
``sources.tables``) over their whole extent.  Output columns are aliased
identically in Spark and SQL; integers are ``bigint`` and doubles are
compared after rounding to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


def r6(c: Column) -> Column:
    """Round a double to 6 places the way the oracle's ``round(x, 6)`` does
    (scale, round half away from zero, unscale), so ties agree."""
    return F.round(c.cast("double") * 1e6, 0) / 1e6


#: The random order of ``splits.hash_order`` with seed 1, as text that sorts like it.
HASH_ORDER_SQL = "substr(md5('1|' || revisionId), 1, 15)"

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with an optional oracle statement."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def load_all() -> None:
    # Importing the modules registers their queries.
    from . import (q_sources, q_steps, q_windows, q_stats, q_curves,  # noqa: F401
                   q_text, q_models)
