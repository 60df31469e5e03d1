"""All queries of the core, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, graphs, ranking, scalars, stores

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (scalars, ranking, graphs, evaluation, stores)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
