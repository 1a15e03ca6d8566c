"""Queries by name, their SQL, and the flagship query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.stats import report
from glyphmill.plans.oracle import SQL
from glyphmill.plans.queries import QUERIES, token_counts


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(token_counts(spark, sf_dir), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
