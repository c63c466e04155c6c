"""All queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import leakage_queries as p7
from sitelens.llm import mixing_queries as p8
from sitelens.llm import pages
from sitelens.llm import percentile_queries as p6
from sitelens.llm import subject_queries as p9

_MODULES = (pages, p6, p7, p8, p9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
