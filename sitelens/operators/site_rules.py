"""Rules that look at several pages: duplicates, links, orphans, platforms, vitals.

Every side of a join here grows with the pages, and the planner guesses its size from compressed files and
nested columns, so each join forbids a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import web_trim
from sitelens.operators.duplicates import exact_members, near_pairs
from sitelens.operators.rules import said
from sitelens.tables import first_listed, numbered

#: Strings that give a platform away in text, headers, images or links, and what each counts.
SIGNALS = {
    "shopify": (4, ["cdn.shopify.com", "Shopify.theme", "myshopify.com"]),
    "wordpress": (4, ["/wp-content/", "/wp-includes/", "wp-json"]),
    "woocommerce": (5, ["woocommerce", "wc-api", "wc-cart"]),
    "webflow": (5, ["data-wf-page", "assets.website-files.com", "uploads-ssl.webflow.com"]),
    "wix": (5, ["parastorage.com", "wix.com", "wix-warmup-data"]),
    "squarespace": (5, ["squarespace.com", "static1.squarespace.com"]),
    "nextjs": (5, ["__NEXT_DATA__", "_next/static"]),
}
#: The order in which platforms are preferred, the points that decide, the pages looked at.
PREFERENCE = ["shopify", "woocommerce", "wordpress", "webflow", "wix", "squarespace", "nextjs"]
ENOUGH, PAGES_LOOKED_AT = 4, 10
SITE_SAMPLE = 10


def _issue(category: str, code: str, severity: str, name: str, message: str, /, **detail: Column) -> list[Column]:
    """The columns of an issue; {name} in the message is filled with the detail of that name."""
    text = F.to_json(F.struct(*[c.alias(k) for k, c in detail.items()])) if detail else F.lit(None).cast("string")
    return [F.lit(category).alias("category"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(name).alias("title"), said(message, **detail).alias("message"), text.alias("detail")]


_KEYS = ("scan_id", "page_id", "url")


def duplicate_field(pages: DataFrame, field: str, least: int = 0) -> DataFrame:
    """Pages that share a field (trimmed, in lower case) with others of their scan: (scan_id, page_id, page_ord, url, norm, value, n).

    Null and blank values, and those of at most ``least`` characters, are not
    compared. Sizes are counted map-side first and joined back.
    """
    value = web_trim(F.col(field))
    rows = pages.where(F.length(value) > least).select(*_KEYS, "page_ord", F.lower(value).alias("norm"), value.alias("value"))
    sizes = rows.groupBy("scan_id", "norm").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes.hint("merge"), ["scan_id", "norm"])


def _with_urls(found: DataFrame, by: list[str]) -> DataFrame:
    """The rows with column shared_urls, the first URLs of their group in page order; n beside it counts all, :func:`group_rows` lists all."""
    return found.join(first_listed(found, by, ["page_ord", "page_id"], "url", "shared_urls").hint("merge"), by)


def group_rows(found: DataFrame, by: list[str], value: str = "url") -> DataFrame:
    """(by, ord, page_id, value): every member of every group in page order, however many, as rows.

    Positions are counted in chunks of page order, so that a group of a third of all pages is spread over tasks.
    """
    return numbered(found.select(*by, "page_ord", "page_id", value), by, "page_ord", "page_id")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    found = _with_urls(duplicate_field(pages, "title"), ["scan_id", "norm"])
    return found.select(*_KEYS, *_issue("technical", "DUPLICATE_TITLE", "high", "Title used more than once", "{pages} pages of the scan have the title {title}.", pages=F.col("n"), sharedUrls=F.col("shared_urls"), title=F.col("value")))


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    found = _with_urls(duplicate_field(pages, "meta_description", 10), ["scan_id", "norm"])
    return found.select(*_KEYS, *_issue("technical", "DUPLICATE_META_DESCRIPTION", "medium", "Meta description used more than once", "{pages} pages of the scan have this meta description.", pages=F.col("n"), sharedUrls=F.col("shared_urls"), descriptionSnippet=F.substring("value", 1, 80)))


def links(pages: DataFrame, column: str = "internal_links") -> DataFrame:
    """The edge list: (scan_id, page_id, page_ord, from_url, link_ord, target_url, anchor_text, link_status, hops)."""
    hops = F.col("l.hops") if column == "internal_links" else F.lit(None).cast("int")
    flat = pages.select("scan_id", "page_id", "page_ord", F.col("url").alias("from_url"), F.posexplode(column).alias("link_ord", "l"))
    return flat.select("scan_id", "page_id", "page_ord", "from_url", "link_ord", F.col("l.url").alias("target_url"), F.col("l.anchor_text").alias("anchor_text"), F.col("l.status_code").alias("link_status"), hops.alias("hops"))


def status_by_url(pages: DataFrame) -> DataFrame:
    """(scan_id, target_url, target_status): the status of the last page with this URL, before or after redirects."""
    both = F.explode(F.array(F.struct((F.col("page_ord") * 2).alias("o"), F.col("url").alias("u")), F.struct((F.col("page_ord") * 2 + 1).alias("o"), F.col("final_url").alias("u")))).alias("x")
    return pages.select("scan_id", "status_code", both).where("x.u is not null").groupBy("scan_id", F.col("x.u").alias("target_url")).agg(F.max_by("status_code", "x.o").alias("target_status"))


def broken_internal_links(pages: DataFrame) -> DataFrame:
    hit = links(pages).join(status_by_url(pages).hint("merge"), ["scan_id", "target_url"]).where("target_status >= 400")
    return hit.select(
        "scan_id", "page_id", F.col("from_url").alias("url"),
        *_issue("technical", "BROKEN_INTERNAL_LINK", "critical", "Link to a page that fails", "The link to {targetUrl} leads to status {targetStatus}.", targetUrl=F.col("target_url"), targetStatus=F.col("target_status"), anchorText=F.col("anchor_text")),
    )


def broken_external_links(pages: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """External links with a status of 400 or more, and the rows (scan_id, url, target_url, status) of a separate probe."""
    out = links(pages, "external_links").where("link_status >= 400").select("scan_id", "page_id", F.col("from_url").alias("url"), F.col("target_url").alias("t"), F.col("link_status").alias("s"))
    if supplied is not None:
        out = out.unionByName(supplied.select("scan_id", F.lit(None).cast("bigint").alias("page_id"), "url", F.col("target_url").alias("t"), F.col("status").alias("s")))
    return out.select(*_KEYS, *_issue("technical", "BROKEN_EXTERNAL_LINK", "medium", "Link to another site fails", "The link to {target} leads to status {status}.", target=F.col("t"), status=F.col("s")))


def redirect_chains(pages: DataFrame) -> DataFrame:
    hit = links(pages).where("hops >= 2")
    return hit.select("scan_id", "page_id", F.col("from_url").alias("url"), *_issue("technical", "REDIRECT_CHAIN", "medium", "Link is redirected more than once", "The link to {target} is redirected {hops} times.", target=F.col("target_url"), hops=F.col("hops")))


def orphans(listed: DataFrame, pages: DataFrame, roots: DataFrame, normal) -> DataFrame:
    """Rows (scan_id, url, ord) of ``listed`` that no page links to and that are not the root; repeats of the list are kept.

    ``normal`` is the URL normaliser both sides go through.
    """
    targets = links(pages).select("scan_id", normal(F.col("target_url")).alias("__u")).unionByName(roots.select("scan_id", normal(F.col("root_url")).alias("__u"))).distinct()
    return listed.withColumn("__u", normal(F.col("url"))).join(targets.hint("merge"), ["scan_id", "__u"], "left_anti").drop("__u")


def orphan_issues(found: DataFrame, most: int = SITE_SAMPLE) -> DataFrame:
    """The first orphans of each scan, in the order of the list."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord", "url"))
    return found.withColumn("__r", rank).where(F.col("__r") <= most).select("scan_id", F.lit(None).cast("bigint").alias("page_id"), "url", *_issue("technical", "ORPHAN_PAGE", "low", "Listed page without links to it", "No page links to {url}, which the sitemap lists.", url=F.col("url")))


def site_files(scans: DataFrame) -> DataFrame:
    """Missing robots.txt and missing or empty sitemap, from (scan_id, robots_found, sitemap_found, sitemap_urls)."""
    none = F.lit(None)
    robots = scans.where(~F.coalesce("robots_found", F.lit(False))).select("scan_id", none.cast("bigint").alias("page_id"), none.cast("string").alias("url"), *_issue("technical", "ROBOTS_TXT_MISSING", "medium", "No robots.txt", "The site has no robots.txt."))
    sitemap = scans.where(~F.coalesce("sitemap_found", F.lit(False)) | (F.coalesce("sitemap_urls", F.lit(0)) == 0))
    return robots.unionByName(sitemap.select("scan_id", none.cast("bigint").alias("page_id"), none.cast("string").alias("url"), *_issue("technical", "SITEMAP_MISSING_OR_EMPTY", "medium", "No sitemap or an empty one", "The site has no sitemap, or one without addresses.")))


def duplicate_content(pages: DataFrame) -> DataFrame:
    """One issue for each page whose text equals another's of the scan but for case, marks and spacing."""
    found = _with_urls(exact_members(pages, ["scan_id"]), ["scan_id", "content_hash"])
    return found.select(*_KEYS, *_issue("technical", "EXACT_DUPLICATE_CONTENT", "medium", "Text found on several pages", "{pages} pages of the scan have the same text.", pages=F.col("n"), duplicateUrls=F.col("shared_urls")))


def near_duplicate_content(pages: DataFrame, most: int = SITE_SAMPLE) -> DataFrame:
    """The first near-duplicate pairs of each scan, attached to the earlier page."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("ord_a", "ord_b"))
    first = near_pairs(pages, ["scan_id"], first=most + 1).withColumn("__r", rank).where(F.col("__r") <= most)
    return first.select("scan_id", F.col("id_a").alias("page_id"), F.col("url_a").alias("url"), *_issue("technical", "NEAR_DUPLICATE_CONTENT", "medium", "Text much like another page's", "{similarity} per cent of the text is that of {urlB}.", urlA=F.col("url_a"), urlB=F.col("url_b"), similarity=F.col("similarity")))


def platforms(pages: DataFrame) -> DataFrame:
    """(scan_id, platform, confidence, signals) from the first ten pages of each scan.

    Points are summed over the pages; the first platform of the preference with
    enough points is taken, else 'custom'.
    """
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("page_ord", "page_id"))
    first = pages.select("scan_id", "page_id", "page_ord", "url", "body_text", "headers", "images", "internal_links").withColumn("__r", rank).where(F.col("__r") <= PAGES_LOOKED_AT)
    nothing = F.lit("")
    raw = F.concat_ws(" ", F.coalesce("body_text", nothing), F.coalesce(F.to_json("headers"), nothing), F.coalesce(F.to_json("images"), nothing), F.coalesce(F.to_json("internal_links"), nothing))
    holds = {name: F.lit(False) for name in SIGNALS}
    for name, (_, marks) in SIGNALS.items():
        for mark in marks:
            holds[name] = holds[name] | F.col("__raw").contains(mark)
    url = F.lower(F.coalesce("url", nothing))
    shop_path = F.when(url.contains("/collections/") | url.contains("/products/"), 2).otherwise(0)
    points = {name: F.sum(F.when(holds[name], SIGNALS[name][0]).otherwise(0) + (shop_path if name == "shopify" else F.lit(0))).alias(name) for name in SIGNALS}
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*[F.when(holds[n], F.lit(n)) for n in SIGNALS]))))))
    scored = first.withColumn("__raw", raw).groupBy("scan_id").agg(*points.values(), seen.alias("signals"))
    platform, confidence = F.lit("custom"), F.lit(50)
    for name in reversed(PREFERENCE):
        platform = F.when(F.col(name) >= ENOUGH, F.lit(name)).otherwise(platform)
        confidence = F.when(F.col(name) >= ENOUGH, F.least(F.lit(100), F.col(name) * 20)).otherwise(confidence)
    return scored.select("scan_id", platform.alias("platform"), confidence.cast("int").alias("confidence"), "signals")


def platform_issues(pages: DataFrame, detected: DataFrame) -> DataFrame:
    """Rules for shops on Shopify and sites on WordPress; other platforms have none."""
    url, canonical = F.lower("url"), F.lower(F.coalesce("canonical_url", F.lit("")))
    product = url.contains("/products/") | url.contains("/product/")
    nested = url.contains("/collections/") & url.contains("/products/") & ((canonical == "") | (canonical.contains("/collections/") & canonical.contains("/products/")))
    typed = F.exists(F.coalesce("structured_data_types", F.array().cast("array<string>")), lambda t: F.lower(t).contains("product"))
    shop, press = F.col("platform") == "shopify", F.col("platform").isin("wordpress", "woocommerce")
    rules = [
        (shop & nested, _issue("technical", "SHOPIFY_COLLECTION_PRODUCT_DUPLICATE", "high", "Product under a collection's URL", "The product {url} is reached below a collection and names no URL of its own.", url=F.col("url"), canonical=F.col("canonical_url"))),
        (shop & (url.contains("?variant=") | url.contains("&variant=")), _issue("technical", "SHOPIFY_VARIANT_PARAM_BLOAT", "medium", "URL for each variant", "{url} is a page for one variant of a product.", url=F.col("url"))),
        (shop & product & ~typed, _issue("onpage", "MISSING_PRODUCT_SCHEMA", "high", "Product without structured data", "The product page {url} has no structured data of a product.", url=F.col("url"))),
        (press & (url.contains("attachment_id=") | url.contains("/attachment/")), _issue("technical", "WORDPRESS_ATTACHMENT_PAGE_BLOAT", "medium", "Page for a mere attachment", "{url} is a page for an attachment.", url=F.col("url"))),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(*issue)) for test, issue in rules]))
    return pages.join(detected.select("scan_id", "platform").hint("merge"), "scan_id").select(*_KEYS, F.explode(each).alias("i")).select(*_KEYS, "i.*")


def vitals_issues(metrics: DataFrame, *keys: str) -> DataFrame:
    """Issues of measured or estimated vitals (columns lcp, cls, tbt)."""
    rules = [
        (F.col("lcp") > 4.0, _issue("performance", "POOR_LCP", "high", "Main content late", "The main content appears after {lcp} seconds; more than 4 are poor.", lcp=F.col("lcp"))),
        ((F.col("lcp") > 2.5) & (F.col("lcp") <= 4.0), _issue("performance", "NEEDS_WORK_LCP", "medium", "Main content could be sooner", "The main content appears after {lcp} seconds; up to 2.5 are good.", lcp=F.col("lcp"))),
        (F.col("cls") > 0.25, _issue("performance", "POOR_CLS", "high", "Layout moves", "The layout shifts by {cls} while loading; more than 0.25 is poor.", cls=F.col("cls"))),
        (F.col("tbt") > 600, _issue("performance", "POOR_TBT", "high", "Page blocked while loading", "The page is blocked for {tbt} milliseconds; more than 600 are poor.", tbt=F.col("tbt"))),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(*issue)) for test, issue in rules]))
    return metrics.select(*keys, F.explode(each).alias("i")).select(*keys, "i.*")


def estimated_vitals(pages: DataFrame, *keys: str) -> DataFrame:
    """Vitals estimated from response time, images and words, with the score and the number of opportunities."""
    time = F.coalesce("response_time_ms", F.lit(500)) / 1000
    images = F.greatest(F.coalesce(F.size("images"), F.lit(0)), F.lit(0))
    words = F.coalesce("word_count", F.lit(500))
    two = lambda c: F.floor(c * 100 + 0.5) / 100
    lcp = two(F.least(F.lit(6.0), 0.9 + time * 1.8 + F.when(images > 10, 1.0).otherwise(images * 0.05)))
    fcp = two(F.least(F.lit(4.0), 0.6 + time * 1.3))
    cls = F.when(images > 8, 0.14).when(images > 3, 0.06).otherwise(0.02)
    tbt = F.least(F.lit(900), F.floor(60 + words / 25 + images * 14 + 0.5)).cast("int")
    inp = F.least(F.lit(500), 100 + images * 12).cast("int")
    out = pages.select(*keys, lcp.alias("lcp"), fcp.alias("fcp"), cls.alias("cls"), tbt.alias("tbt"), inp.alias("inp"), images.alias("__images"))
    fine = lambda test, n: F.when(test, n).otherwise(0)
    c = F.col
    lost = fine(c("lcp") > 2.5, 18) + fine(c("lcp") > 4.0, 15) + fine(c("cls") > 0.1, 12) + fine(c("cls") > 0.25, 12) + fine(c("tbt") > 200, 12) + fine(c("tbt") > 600, 12) + fine(c("fcp") > 1.8, 8)
    chances = fine(c("__images") > 5, 1) + fine(c("lcp") > 2.5, 1)
    return out.select(*keys, F.greatest(F.lit(20), F.least(F.lit(99), 100 - lost)).cast("int").alias("perf_score"), "lcp", "fcp", "cls", "tbt", "inp", chances.alias("n_opportunities"))


#: What the estimate proposes, and the milliseconds it would save.
ESTIMATED = {"images": ("Serve smaller pictures in modern formats", 60), "server": ("Answer sooner and load the main content first", 0)}


def estimated_opportunities(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, kind, title, savings_ms): the opportunities behind :func:`estimated_vitals` as rows.

    More than five images would save a share for each; a main content later than 2.5
    seconds would save what it is late by.
    """
    images = F.greatest(F.coalesce(F.size("images"), F.lit(0)), F.lit(0))
    vitals = estimated_vitals(pages.withColumn("__n", images), *keys, "__n")
    kinds = [
        (F.col("__n") > 5, "images", F.col("__n") * ESTIMATED["images"][1]),
        (F.col("lcp") > 2.5, "server", F.floor((F.col("lcp") - 2.5) * 1000 + 0.5)),
    ]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(ESTIMATED[k][0]).alias("title"), ms.cast("bigint").alias("savings_ms"))) for test, k, ms in kinds]))
    return vitals.select(*keys, F.posexplode(each).alias("ord", "o")).select(*keys, "ord", "o.*")
