"""Read models: filters, lists, groupings and summaries over stored scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.scores import severity_counts, severity_rank
from sitelens.tables import first_listed


def wildcard(column: str, wanted: str | None) -> Column:
    """Equality, or everything for None, '' and 'all'."""
    return F.lit(True) if wanted in (None, "", "all") else F.col(column) == wanted


def issue_list(issues: DataFrame, scan_id: str | None = None, category: str | None = None, severity: str | None = None) -> DataFrame:
    """Issues under optional filters; order by severity name and code."""
    out = issues.where(wildcard("scan_id", scan_id)).where(wildcard("category", category)).where(wildcard("severity", severity))
    return out.orderBy("severity", "code", "issue_id")


def page_search(pages: DataFrame, search: str | None = None, status: str | int | None = None) -> DataFrame:
    """Pages whose URL or title holds the text in any case, with a status; a blank text or a status that is no number keeps all."""
    out = pages
    if search and search.strip():
        low = search.strip().lower()
        out = out.where(F.coalesce(F.lower("url").contains(low), F.lit(False)) | F.coalesce(F.lower("title").contains(low), F.lit(False)))
    if status is not None and str(status).strip().lstrip("-").isdigit():
        out = out.where(F.col("status_code") == int(status))
    return out


def paged(df: DataFrame, *order: str | Column, page: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered list; give a tie-break as last key."""
    return df.orderBy(*order).offset(max(0, page - 1) * size).limit(size)


def with_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """``parents`` with the number of rows of each child table; children are counted before the join."""
    out = parents
    for name, child in children.items():
        counted = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def issue_groups(issues: DataFrame, urls: DataFrame) -> DataFrame:
    """(scan_id, rank, code, category, severity, n, n_urls, urls): issues by code, worst and most frequent first in each scan.

    ``urls`` are the distinct page URLs in the order of the issues (the first
    thousand; ``n_urls`` counts all and :func:`issue_group_urls` lists all); category and severity are those of the first issue.
    """
    rows = issues.join(urls.select("page_id", F.col("url").alias("page_url")), "page_id", "left")
    seen = rows.where("page_url is not null").groupBy("scan_id", "code", "page_url").agg(F.min("issue_id").alias("first_id"))
    counted = seen.groupBy("scan_id", "code").agg(F.count("*").alias("n_urls")).join(first_listed(seen, ["scan_id", "code"], ["first_id", "page_url"], "page_url", "urls"), ["scan_id", "code"])
    by = rows.groupBy("scan_id", "code").agg(F.count("*").alias("n"), F.min_by("category", "issue_id").alias("category"), F.min_by("severity", "issue_id").alias("severity"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(severity_rank(F.col("severity")), F.desc("n"), "code"))
    none = F.array().cast("array<string>")
    return by.join(counted, ["scan_id", "code"], "left").select("scan_id", rank.alias("rank"), "code", "category", "severity", "n", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.coalesce("urls", none).alias("urls"))


def issue_group_urls(issues: DataFrame, urls: DataFrame) -> DataFrame:
    """(scan_id, code, first_id, page_url): every distinct page URL of every group as rows; ``first_id``, the first issue with it, gives their order."""
    rows = issues.join(urls.select("page_id", F.col("url").alias("page_url")), "page_id")
    return rows.where("page_url is not null").groupBy("scan_id", "code", "page_url").agg(F.min("issue_id").alias("first_id")).select("scan_id", "code", "first_id", "page_url")


def with_details(issues: DataFrame) -> DataFrame:
    """Issues with column detail_fields, the parsed detail: names to JSON texts, null where there is no JSON object."""
    return issues.withColumn("detail_fields", F.when(F.col("detail").rlike(r"^\s*\{"), F.from_json("detail", "map<string,string>")))


def group_details(issues: DataFrame) -> DataFrame:
    """(scan_id, code, issue_id, detail_fields): the details of every group as rows, in any number."""
    return with_details(issues).where("detail_fields is not null").select("scan_id", "code", "issue_id", "detail_fields")


def total(found: DataFrame, size: int = 50) -> DataFrame:
    """(total, pages): the rows of a list and the pages of ``size`` rows they fill, for what :func:`paged` shows."""
    return found.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("bigint").alias("pages"))


def first_of_group(issues: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` issues of each code of a scan."""
    rank = F.row_number().over(Window.partitionBy("scan_id", "code").orderBy("issue_id"))
    return issues.withColumn("rank", rank).where(F.col("rank") <= k)


def metric_view(metrics: DataFrame, compat: bool = False) -> DataFrame:
    """Vitals with defaults where they are null; with ``compat`` also where they are zero."""
    defaults = {"perf_score": 85, "lcp": 2.1, "inp": 120, "cls": 0.04, "fcp": 1.2, "tbt": 150}
    return metrics.select("metric_id", "page_id", *[F.coalesce(F.nullif(F.col(c), F.lit(0)) if compat else F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def root_page(pages: DataFrame, scans: DataFrame) -> DataFrame:
    """The page that stands for each scan: that of the root URL, else the first."""
    rows = pages.join(scans.select("scan_id", "root_url"), "scan_id")
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy((F.col("url") == F.col("root_url")).desc_nulls_last(), "page_ord", "page_id"))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def issues_with_pages(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Every issue with URL, title and status of its page, null without one."""
    return issues.join(pages.select("page_id", "url", F.col("title").alias("page_title"), "status_code"), "page_id", "left")


def issue_page_ids(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues that name a URL get the id of the scan's last page with it, null if there is none."""
    last = pages.groupBy("scan_id", "url").agg(F.max_by("page_id", "page_ord").alias("page_id"))
    return issues.drop("page_id").join(last, ["scan_id", "url"], "left")


def export_issues(issues: DataFrame, pages: DataFrame, scans: DataFrame) -> DataFrame:
    """One row for each code of a scan: rank, number, the first issue's message and page URL, the root URL without a page."""
    rows = issues.join(pages.select("page_id", "url"), "page_id", "left").join(scans.select("scan_id", "root_url"), "scan_id")
    by = rows.groupBy("scan_id", "code").agg(F.count("*").alias("n"), F.min("issue_id").alias("first_id"), F.min_by("message", "issue_id").alias("message"), F.min_by(F.coalesce("url", "root_url"), "issue_id").alias("url"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("first_id"))
    return by.select("scan_id", rank.alias("row"), "code", "n", "message", "url")


def scan_summary(scans: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Scans with page and issue counts and a count for each severity."""
    counted = with_counts(scans.select("scan_id", "root_url", "status", "overall_score"), "scan_id", n_pages=pages.select("scan_id"))
    by = severity_counts(issues).withColumnRenamed("total", "n_issues")
    out = counted.join(by, "scan_id", "left")
    return out.select("scan_id", "root_url", "status", "overall_score", "n_pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in by.columns if c != "scan_id"])


def with_metrics(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pages with their vitals, null without any."""
    return pages.join(metrics.select("page_id", "perf_score", "lcp", "cls", "tbt"), "page_id", "left")


def metrics_of_scan(metrics: DataFrame, pages: DataFrame, scan_id: str) -> DataFrame:
    """The vitals of a scan's pages."""
    return metrics.join(pages.where(F.col("scan_id") == scan_id).select("page_id"), "page_id", "left_semi")


def nested(scans: DataFrame, pages: DataFrame) -> DataFrame:
    """(scan_id, root_url, n_pages, pages): each scan with its first thousand pages in order and the number of all; the pages themselves are the rows of the page table."""
    rows = pages.select("scan_id", "page_ord", "page_id", F.struct("page_ord", "page_id", "url").alias("page"))
    lists = first_listed(rows, ["scan_id"], ["page_ord", "page_id"], "page", "pages")
    return with_counts(scans.select("scan_id", "root_url"), "scan_id", n_pages=pages.select("scan_id")).join(lists, "scan_id", "left")
