"""Every query of the engine's own operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES, SQL, browse, engine, reading, scalar, search, sets, timed  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_lexical"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
