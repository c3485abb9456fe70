"""The registered queries of the analytics operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.views import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}
_ROUNDED: dict[str, tuple[str, ...]] = {}


def register(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Register a function of ``Views`` under a name, with DuckDB SQL over the views' names for the same rows.

    Columns in ``rounded`` are sums of doubles, whose last digits depend on the order of adding;
    both sides round them to six decimals.
    """

    def put(function: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = (lambda v: function(v).withColumns({c: F.round(c, 6) for c in rounded})) if rounded else function
        if sql:
            _SQL[name] = sql
            _ROUNDED[name] = rounded
        return function

    return put


def _load() -> None:
    from sightline.plans import ai_queries, audit_queries, demand_queries, keyword_queries, maintenance_queries, rank_queries, search_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    out = {}
    for name, sql in _SQL.items():
        out[name] = with_views(sql)
        if _ROUNDED[name]:
            out[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED[name])}) FROM ({out[name]}) t"
    return out
