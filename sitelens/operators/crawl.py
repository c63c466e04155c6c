"""Breadth-first crawl over stored pages, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import normal_url, url_host
from sitelens.session import cut


#: Seeds are queued before any link: their keys are lower.
SEEDS_FIRST = 10**15


def crawl_order(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_pages: int = 25, bounds: DataFrame | None = None) -> DataFrame:
    """(scan_id, url, depth, ord): the pages of each scan in the order they are met.

    ``seeds`` has (scan_id, url, depth, seed_ord); ``edges`` (scan_id, from_url,
    link_ord, target_url). Addresses are normalised, each is met once, links to
    other hosts than the first seed's are not followed, and every scan stops at
    its number of pages. The links of a page are taken up only while the pages met and
    waiting are fewer than twice that number. ``bounds`` (scan_id, max_depth, max_pages) gives scans bounds of their own; null or
    missing ones are ``max_depth`` and ``max_pages``. A level is one join, an anti join with what was met, and a
    rank; it ends in files of the shared checkpoint folder. The loop ends when no scan has pages waiting.
    """
    norm = cut(edges.select("scan_id", normal_url(F.col("from_url")).alias("from_url"), "link_ord", normal_url(F.col("target_url")).alias("url")).where("url is not null"))
    own = seeds.groupBy("scan_id").agg(F.min_by(url_host(F.col("url")), F.struct("depth", "seed_ord")).alias("home"))
    if bounds is None:
        own = own.withColumns({"most_depth": F.lit(max_depth), "most": F.lit(max_pages)})
    else:
        given = bounds.select("scan_id", F.col("max_depth").alias("__d"), F.col("max_pages").alias("__p"))
        own = own.join(given, "scan_id", "left").select("scan_id", "home", F.coalesce("__d", F.lit(max_depth)).alias("most_depth"), F.coalesce("__p", F.lit(max_pages)).alias("most"))
    own = cut(own)
    deepest = own.agg(F.max("most_depth")).first()[0]
    first = seeds.withColumn("url", normal_url(F.col("url")))
    waiting = first.groupBy("scan_id", "url").agg(F.min(F.struct("depth", "seed_ord")).alias("k")).select("scan_id", "url", F.col("k.depth").alias("depth"), (F.col("k.seed_ord") - SEEDS_FIRST).cast("bigint").alias("key"))
    met = None
    for depth in range((deepest if deepest is not None else max_depth) + 1):
        here = waiting.where(F.col("depth") == depth).join(own.select("scan_id", "most"), "scan_id")
        rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("key", "url"))
        ranked = here.withColumn("r", rank).where(F.col("r") <= F.col("most"))
        if met is not None:
            used = met.groupBy("scan_id").agg(F.count("*").alias("used"))
            ranked = ranked.join(used, "scan_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        else:
            ranked = ranked.withColumn("used", F.lit(0))
        taken = cut(ranked.where(F.col("r") + F.col("used") <= F.col("most")).select("scan_id", "url", "depth", (F.col("r") + F.col("used") - 1).cast("bigint").alias("ord")))
        met = taken if met is None else cut(met.unionByName(taken))
        # links of the pages taken to addresses that are new, each by the first link to it
        found = taken.withColumnsRenamed({"url": "from_url", "depth": "from_depth"}).join(norm, ["scan_id", "from_url"]).join(own, "scan_id").where((url_host(F.col("url")) == F.col("home")) & (F.col("from_depth") < F.col("most_depth")))
        later = waiting.where(F.col("depth") > depth)
        known = met.select("scan_id", "url").unionByName(later.select("scan_id", "url"))
        fresh = found.groupBy("scan_id", "url", "most").agg(F.min(F.struct("ord", "link_ord")).alias("k")).join(known, ["scan_id", "url"], "left_anti")
        # the pages whose links are taken up: those reached before twice the bound is
        start = known.groupBy("scan_id").agg(F.count("*").alias("start"))
        gains = fresh.groupBy("scan_id", "most", F.col("k.ord").alias("from_ord")).agg(F.count("*").alias("n")).join(start, "scan_id")
        before = F.sum("n").over(Window.partitionBy("scan_id").orderBy("from_ord")) - F.col("n") + F.col("start")
        open_pages = gains.withColumn("before", before).where(F.col("before") < 2 * F.col("most")).select("scan_id", "from_ord")
        fresh = fresh.withColumn("from_ord", F.col("k.ord")).join(open_pages, ["scan_id", "from_ord"], "left_semi")
        fresh = fresh.select("scan_id", "url", F.lit(depth + 1).alias("depth"), (F.col("k.ord") * 1_000_000 + F.col("k.link_ord")).cast("bigint").alias("key"))
        waiting = cut(later.select("scan_id", "url", "depth", "key").unionByName(fresh))
        if waiting.isEmpty():
            break
    return met


def _without_content(urls: DataFrame, status: int, directives: str | None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return urls.select("scan_id", "url", F.col("url").alias("final_url"), "depth", F.lit(status).alias("status_code"), F.lit(0).alias("response_time_ms"), none("string").alias("title"), F.lit("").alias("body_text"), F.lit(0).alias("word_count"), F.array().cast("array<string>").alias("h1_list"), F.lit(directives).cast("string").alias("robots_directives"), none("struct<hsts:boolean,csp:boolean,x_content_type_options:boolean,x_frame_options:boolean,referrer_policy:boolean>").alias("security_headers"))


def failed_pages(urls: DataFrame) -> DataFrame:
    """Page records for addresses whose fetch failed: status 500, no content, no header struct, so that no header rule applies."""
    return _without_content(urls, 500, None)


def blocked_pages(urls: DataFrame) -> DataFrame:
    """Page records for addresses that robots.txt forbids: status 403, no content, no header struct, so that no header rule applies."""
    return _without_content(urls, 403, "Disallowed in robots.txt")
