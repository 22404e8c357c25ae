"""Collects the registered queries of all modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cohorts, content, fields, graphs, layout, logs, maintenance, mining, ordered, pages, ranking, references, search, selections, stored, structure, urls, values, vectors, xpaths

_MODULES = [search, xpaths, vectors, logs, graphs, urls, pages, maintenance, values, selections, structure, fields, mining, cohorts, references, layout, ordered, stored, content, ranking]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
