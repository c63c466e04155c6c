"""Weighted health scores, ranked deductions and severity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import half_up

#: Points an issue costs by severity, the order of severities, and the weight of each category.
PENALTY = {"critical": 15, "high": 8, "medium": 4, "low": 1}
SEVERITIES = ["critical", "high", "medium", "low"]
WEIGHTS = {"technical": 0.30, "onpage": 0.25, "performance": 0.25, "security": 0.10, "accessibility": 0.10}
#: Least overall score of each grade.
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 45)]


def penalty(severity: Column) -> Column:
    out = F.lit(1)
    for name, points in PENALTY.items():
        out = F.when(severity == name, points).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for anything else."""
    out = F.lit(4)
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def grade(score: Column) -> Column:
    out = F.lit("F")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def scores(scans: DataFrame, issues: DataFrame, blend: bool = True) -> DataFrame:
    """(scan_id, five category scores, overall, grade) for every row of ``scans`` (scan_id, perf_score or null).

    Each category starts at 100 and loses its issues' points, down to 0. A
    measured performance score is where that category starts; with ``blend``
    the loss is then taken from the measured score by half again (the
    observed behaviour), without it the issues are counted once.
    """
    lost = issues.groupBy("scan_id").agg(*[F.sum(F.when(F.col("category") == c, penalty(F.col("severity"))).otherwise(0)).alias(f"lost_{c}") for c in WEIGHTS])
    rows = scans.select("scan_id", "perf_score").join(lost, "scan_id", "left")
    left = {c: F.greatest(F.lit(0), (F.coalesce("perf_score", F.lit(100)) if c == "performance" else F.lit(100)) - F.coalesce(f"lost_{c}", F.lit(0))) for c in WEIGHTS}
    measured = F.col("perf_score").isNotNull()
    blended = half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("perf_score") - (100 - left["performance"]) * 0.5)))
    if blend:
        left["performance"] = F.when(measured, blended).otherwise(left["performance"])
    out = rows.select("scan_id", *[v.cast("int").alias(c) for c, v in left.items()])
    total = F.lit(0)
    for c, weight in WEIGHTS.items():
        total = total + F.col(c) * round(weight * 100)
    out = out.withColumn("overall", F.floor((total + 50) / 100).cast("int"))
    return out.withColumn("grade", grade(F.col("overall")))


def deductions(issues: DataFrame, most: int | None = 5) -> DataFrame:
    """(scan_id, rank, category, code, title, severity, deduction, n): what cost most, first seen first among equals.

    ``issues`` has issue_ord, the order of evaluation; title and severity are those of the first issue of a code.
    """
    by = issues.groupBy("scan_id", "category", "code").agg(
        F.sum(penalty(F.col("severity"))).alias("deduction"), F.count("*").alias("n"), F.min("issue_ord").alias("first_ord"),
        F.min_by("title", "issue_ord").alias("title"), F.min_by("severity", "issue_ord").alias("severity"),
    )
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("deduction"), "first_ord", "category", "code"))
    out = by.select("scan_id", rank.alias("rank"), "category", "code", "title", "severity", "deduction", "n")
    return out.where(F.col("rank") <= most) if most else out


def severity_counts(issues: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, total, critical, high, medium, low), zero where there are none."""
    return issues.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(s) for s in SEVERITIES])
