"""Registry of the queries outside the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import continuity, language, planted, records, style

_MODULES = (language, style, records, continuity, planted)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability of the English documents."""
    return language.readability(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
