"""Subjects of documents and the corpus by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import documents, plain_source
from sitelens.llm.subjects import classify, fit
from sitelens.tables import load


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    delivered = load(spark, folder, "documents").select("doc_id", "text", plain_source(F.col("source")).alias("source"), "ingested_at")
    model = fit(delivered, load(spark, folder, "doc_labels"), load(spark, folder, "subjects"))
    return classify(documents(spark, folder, "text", "source").withColumn("source", plain_source(F.col("source"))), model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder).select("doc_id", F.explode("subjects").alias("subject"))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject; '' stands for those without one."""
    subject = F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("")))).alias("subject")
    return _classified(spark, folder).select("doc_id", subject).groupBy("subject").agg(F.count("*").alias("n_docs"))


QUERIES = {"p9_found": p9_found, "p9_composition": p9_composition}
