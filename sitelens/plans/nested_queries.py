"""Queries over the nested texts of scans and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.nested import AI_PLAN, DETAIL, flatten, read_tables, typed_table, write_tables
from sitelens.session import cut_folder
from sitelens.tables import latest, load

#: Tables of the records' own fields; all others are of their children.
RECORDS = ("plan", "issue_detail")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of every plan and detail, as one stream of tagged rows."""
    scans = latest(load(spark, folder, "scans").select("scan_id", "ai_plan", "ingested_at"), "scan_id")
    issues = latest(load(spark, folder, "issues").select("issue_id", "detail", "ingested_at"), "issue_id")
    return flatten(scans, "scan_id", "ai_plan", AI_PLAN, root="plan").unionByName(flatten(issues, "issue_id", "detail", DETAIL, root="issue_detail"))


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes written by tag in one pass and read again; each table is a folder of its own."""
    target = cut_folder(spark)
    write_tables(nodes(spark, folder), target)
    return read_tables(spark, target)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each child, from the written tables."""
    return tables(spark, folder).where(~F.col("tag").isin(*RECORDS)).select(F.col("root_id").alias("parent_id"), F.col("tag").alias("child"), "ord", "sub_ord")


def _told(table: DataFrame) -> DataFrame:
    """The table with its other fields as one JSON text."""
    return table.withColumn("rest", F.to_json("rest"))


def p1_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return _told(typed_table(tables(spark, folder), "recommendation"))


def p1_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Hops with their headers joined back by the parent link."""
    rows = tables(spark, folder)
    hops, headers = typed_table(rows, "hop"), typed_table(rows, "hop_header")
    headers = headers.select(F.col("parent_id").alias("node_id"), F.col("sub_ord").alias("header_ord"), F.col("name").alias("header_name"), F.col("value").alias("header_value"))
    return _told(hops).drop("value", "sub_ord").join(headers, "node_id", "left")


def p1_plans(spark: SparkSession, folder: str) -> DataFrame:
    """The own fields of each plan."""
    return _told(typed_table(tables(spark, folder), "plan"))


QUERIES = {"p1_found": p1_found, "p1_recommendations": p1_recommendations, "p1_hops": p1_hops, "p1_plans": p1_plans}
