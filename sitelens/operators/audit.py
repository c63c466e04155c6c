"""One audit run: every rule over the pages of a crawl, in the order of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import normal_url
from sitelens.operators import site_rules
from sitelens.operators.rules import page_issues

#: Where the issues of several pages begin in the order; those of one page keep their own places below.
ACROSS = 1000


def audit(
    pages: DataFrame, roots: DataFrame, files: DataFrame | None = None, listed: DataFrame | None = None, supplied: DataFrame | None = None, measured: DataFrame | None = None
) -> DataFrame:
    """Rows (scan_id, page_id, url, issue_ord, category, code, severity, title, message, detail) of all 53 codes.

    ``roots`` has (scan_id, root_url); ``files`` (scan_id, robots_found, sitemap_found, sitemap_urls)
    of the site's own files; ``listed`` (scan_id, url, ord) what its sitemap lists, the crawled pages
    where it is not given; ``supplied`` (scan_id, url, target_url, status) failing links to other
    sites from a probe; ``measured`` (scan_id, page_id, url, lcp, cls, tbt) vitals. Inputs that are not given raise no
    issues. Near duplicates and orphans are sampled by scan as their rules say; all else is complete. The platform of
    each scan comes from :func:`sitelens.operators.site_rules.platforms`.
    """
    if listed is None:
        listed = pages.select("scan_id", "url", F.col("page_ord").alias("ord"))
    across = [site_rules.duplicate_titles(pages), site_rules.duplicate_descriptions(pages), site_rules.broken_internal_links(pages)]
    if files is not None:
        across.append(site_rules.site_files(files))
    across += [site_rules.orphan_issues(site_rules.orphans(listed, pages, roots, normal_url)), site_rules.duplicate_content(pages), site_rules.near_duplicate_content(pages)]
    across += [site_rules.broken_external_links(pages, supplied), site_rules.redirect_chains(pages), site_rules.platform_issues(pages, site_rules.platforms(pages))]
    if measured is not None:
        across.append(site_rules.vitals_issues(measured, "scan_id", "page_id", "url"))
    found = page_issues(pages).drop("page_ord")
    for n, each in enumerate(across):
        found = found.unionByName(each.withColumn("issue_ord", F.lit(ACROSS + n)))
    return found


def issue_rows(found: DataFrame) -> DataFrame:
    """The rows of an audit as the issue table stores them: with an id made of scan, place and content, equal for equal runs."""
    key = F.concat_ws("-", "scan_id", F.lpad(F.col("issue_ord").cast("string"), 6, "0"), F.hex(F.xxhash64("page_id", "url", "code", "detail")))
    return found.select(key.alias("issue_id"), "scan_id", "page_id", "category", "code", "severity", "title", "message", "detail")
