"""Named queries, each a Spark function over :class:`Tables` and, where SQL can
say it, an equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annolytics.workload.views import Tables, with_views

_SPARK: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, local: tuple[str, ...] = ()):
    """Register a query. ``local`` names CTEs of its own text that hide a view."""
    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _SPARK:
            raise ValueError(f"query {name} is registered twice")
        _SPARK[name] = build
        if sql is not None:
            _SQL[name] = with_views(sql, local)
        return build
    return keep


def _load() -> None:
    from annolytics.workload import page_queries, state_queries, text_queries  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Callable[[Tables], DataFrame]):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in _SPARK.items()}


def sql_texts() -> dict[str, str]:
    _load()
    return dict(_SQL)
