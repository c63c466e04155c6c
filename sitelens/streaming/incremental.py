"""Auditing pages as they arrive in a folder (beyond the batch engine's scope, see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelens.operators.rules import page_issues


def audit_stream(spark: SparkSession, source: str, target: str, state: str) -> StreamingQuery:
    """Issues of every page file that lands in ``source``, appended to ``target`` once; ends when all files are done.

    The page rules read one page at a time, so the stream needs no state but
    the list of files done, which is kept in ``state``.
    """
    pages = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    return page_issues(pages).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()


def severity_windows(issues: DataFrame, stamp: str = "fetched_at", length: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Issues by severity and time window, batch or stream; rows later than ``late`` are dropped by a stream."""
    return issues.withWatermark(stamp, late).groupBy(F.window(stamp, length), "severity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "severity", "n")
