"""Evaluation items that documents give away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import documents
from sitelens.llm.leakage import leaks
from sitelens.tables import load


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    items = load(spark, folder, "eval_items").select("item_id", "passage")
    return leaks(documents(spark, folder, "text"), items, again=lambda hit: documents(spark, folder, "text", only=hit))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """The number of documents that give each leaked item away."""
    items = load(spark, folder, "eval_items").select("item_id", "suite")
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items, "item_id")


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}

_FOUND = """
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
              QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC) = 1),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
items AS (SELECT item_id, suite, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items)),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run))
"""
SQL = {
    "p7_found": _FOUND + "SELECT doc_id, item_id FROM found",
    "p7_items": _FOUND + "SELECT item_id, suite, count(*) AS n_docs FROM found JOIN eval_items USING (item_id) GROUP BY item_id, suite",
}
