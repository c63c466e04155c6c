"""Search analytics: totals and rows of query and page reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """(by, clicks, impressions, ctr in per cent, position weighted by impressions); 0 without impressions."""
    out = rows.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("__w"))
    ratio = lambda a: F.coalesce(F.try_divide(a, F.col("impressions")), F.lit(0.0))
    return out.select(*by, "clicks", "impressions", ratio(F.col("clicks") * 100).alias("ctr"), ratio(F.col("__w")).alias("position"))


def shaped(rows: DataFrame) -> DataFrame:
    """(key, clicks, impressions, ctr of 2 decimals in per cent, position of 1 decimal) from rows with a list of keys."""
    return rows.select(F.try_element_at("keys", F.lit(1)).alias("key"), "clicks", "impressions", (F.floor(F.col("ctr") * 10000 + 0.5) / 100).alias("ctr"), (F.floor(F.col("position") * 10 + 0.5) / 10).alias("position"))


def window_of(rows: DataFrame, days: int = 28, today: str | None = None) -> DataFrame:
    """Rows (with a date) of the last ``days`` days."""
    end = F.lit(today).cast("date") if today else F.current_date()
    return rows.where((F.col("date") >= F.date_sub(end, days)) & (F.col("date") <= end))
