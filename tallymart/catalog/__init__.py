"""Every operator as a named query on the star tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tallymart.session import configure
from tallymart.sources.star import StarMart

_MODULES = ("reports", "charts", "statistics", "forecasts", "advice", "tables", "eight")


def _entries() -> dict[str, tuple[Callable, str | None]]:
    merged: dict[str, tuple[Callable, str | None]] = {}
    for name in _MODULES:
        merged.update(import_module(f"tallymart.catalog.{name}").ENTRIES)
    return merged


def _bound(build: Callable[[StarMart], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(StarMart(configure(spark), folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for name, (build, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
