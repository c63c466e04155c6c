"""Scan requests, demo rows and the choice between measured and estimated vitals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import parse
from sitelens.operators.site_rules import estimated_vitals

#: Defaults and bounds of a scan.
PAGES, MOST_PAGES, DEPTH, MOST_DEPTH = 25, 100, 3, 10


@dataclass(frozen=True)
class ScanRequest:
    url: str
    max_pages: int = PAGES
    max_depth: int = DEPTH


def scan_request(url: str | None, max_pages: int | None = None, max_depth: int | None = None) -> ScanRequest:
    """A request with a full http(s) URL (https where no scheme is given) and bounds of 1 to 100 pages and 1 to 10 levels."""
    text = (url or "").strip()
    text = text if "://" in text else f"https://{text}"
    if parse(text) is None:
        raise ValueError(f"not a web address: {url!r}")
    clamp = lambda v, usual, most: max(1, min(most, int(v) if v is not None else usual))
    return ScanRequest(text, clamp(max_pages, PAGES, MOST_PAGES), clamp(max_depth, DEPTH, MOST_DEPTH))


def search_sites(answers: DataFrame) -> DataFrame:
    """(site_url, permission) of stored site listings (one JSON text a row, column value)."""
    listed = F.from_json("value", "siteEntry array<struct<siteUrl:string,permissionLevel:string>>")
    return answers.select(F.explode(listed["siteEntry"]).alias("s")).select(F.col("s.siteUrl").alias("site_url"), F.col("s.permissionLevel").alias("permission"))


def vitals(pages: DataFrame, measured: DataFrame) -> DataFrame:
    """Vitals of every page: the measured ones (by page_id) where there are any, else the estimate; ``source`` says which."""
    estimate = estimated_vitals(pages, "page_id")
    names = ["perf_score", "lcp", "fcp", "cls", "tbt", "inp"]
    own = measured.select("page_id", *[F.col(n).alias(f"m_{n}") for n in names]).dropDuplicates(["page_id"])
    both = estimate.join(own, "page_id", "left")
    has = F.col("m_perf_score").isNotNull()
    return both.select("page_id", *[F.when(has, F.col(f"m_{n}")).otherwise(F.col(n)).alias(n) for n in names], F.when(has, "measured").otherwise("estimated").alias("source"))


def demo_pages(spark: SparkSession) -> DataFrame:
    """Five pages of an invented site, one of them missing, for trying things out."""
    rows = [("demo", i, i - 1, f"https://shop.example/{p}", s, t) for i, (p, s, t) in enumerate([("", 200, "Shop"), ("about", 200, "About the shop and the people in it"), ("gone", 404, None), ("lamps", 200, "Lamps"), ("chairs", 200, "Lamps")], 1)]
    return spark.createDataFrame(rows, "scan_id string, page_id bigint, page_ord int, url string, status_code int, title string")


def demo_search_rows(spark: SparkSession) -> DataFrame:
    """Search-report rows for the demo site."""
    return spark.createDataFrame([(["lamps"], 12.0, 300.0, 0.04, 5.5), (["chairs"], 3.0, 100.0, 0.03, 9.0)], "keys array<string>, clicks double, impressions double, ctr double, position double")
