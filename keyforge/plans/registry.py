"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame; the
oracle is an independent DuckDB statement over the same parquet tables.
Arrays are compared joined with ``' | '``; doubles rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def show_list(c, sep: str = " | ") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
