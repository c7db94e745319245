"""Query registry: key → (Spark query, DuckDB oracle SQL or None).

Every query takes ``(spark, sf_dir)``, reads the given tables (or fixed
parameter tables joined to them) and returns a DataFrame whose column names
match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn
    return deco


def _load() -> None:
    # importing the modules registers their queries
    from . import (q_dtm, q_lexicon, q_measures, q_models, q_sentiment,  # noqa: F401
                   q_sources, q_target, q_text, q_topics)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
