"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rideloom.plans import aggregating, flowing, joining, learning, problems, reading, scalars, warehouse, windowing

_MODULES = [problems, reading, joining, aggregating, windowing, warehouse, scalars, learning, flowing]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems.p4_driver_hours(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        twice = found.keys() & m.QUERIES.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
