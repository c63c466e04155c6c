"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.plans import audit_queries, audit_sql, fixture_queries, nested_queries


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Health scores of every scan."""
    return audit_queries.scan_scores(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return audit_queries.QUERIES | nested_queries.QUERIES | fixture_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return audit_sql.SQL | fixture_queries.sql()
