"""Query catalogue: a Spark builder per name, with its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, with_views

Builder = Callable[[Views], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    def add(builder: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = builder
        if sql is not None:
            _ORACLES[name] = with_views(sql, *views) if views else sql
        return builder
    return add


def _bind(builder: Builder) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: builder(Views(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(b) for name, b in _BUILDERS.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
