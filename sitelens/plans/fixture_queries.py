"""Queries over small fixed inputs, for operators whose inputs the tables lack: mark-up, site files, reports, sinks, every rule.

What each must give is written by hand beside its input; the SQL is that list.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import url_host, url_path
from sitelens.operators import audit, extract, recommend, search, site_rules
from sitelens.session import cut_folder
from sitelens.sources import files, requests, sinks

#: A page without faults, as fields of the crawl record.
FIELDS = (
    "scan_id string, page_id bigint, page_ord int, url string, final_url string, status_code int, response_time_ms int, title string, meta_description string, h1_list array<string>, headings array<struct<level:int,text:string>>, canonical_url string, "
    "robots_directives string, word_count int, body_text string, images array<struct<src:string,alt:string,width:int,height:int>>, internal_links array<struct<url:string,anchor_text:string,status_code:int,hops:int>>, "
    "external_links array<struct<url:string,anchor_text:string,status_code:int>>, depth int, headers map<string,string>, has_structured_data boolean, structured_data_types array<string>, flesch_score int, ssl_valid boolean, ssl_days_remaining int, "
    "mixed_content array<string>, security_headers struct<hsts:boolean,csp:boolean,x_content_type_options:boolean,x_frame_options:boolean,referrer_policy:boolean>"
)
_U = "https://a.example"


def _page(k: int, scan: str, path: str, **changes) -> tuple:
    url = changes.pop("url", _U + path)
    fine = {
        "scan_id": scan, "page_id": k, "page_ord": k, "url": url, "final_url": url, "status_code": 200, "response_time_ms": 100, "title": f"A title of a fitting length, number {k:03}", "meta_description": f"Page {k:03} of the fixture, described in a text that is neither too short nor too long.",
        "h1_list": ["Heading"], "headings": [(1, "Heading")], "canonical_url": url, "robots_directives": "index", "word_count": 500, "body_text": f"short {k}", "images": [], "internal_links": [(_U + "/", "Start page", None, None)], "external_links": [],
        "depth": 0, "headers": {}, "has_structured_data": True, "structured_data_types": ["Thing"], "flesch_score": 60, "ssl_valid": None, "ssl_days_remaining": None, "mixed_content": None, "security_headers": None,
    }
    return tuple((fine | changes)[f.split()[0]] for f in FIELDS.split(", "))


_TEXT = " ".join(f"stone{i} river{i * 7} cloud{i * 3}" for i in range(60))
#: (scan, path, what differs from a faultless page, the codes its own rules must find)
CASES = [
    ("one", "/", {}, []),
    ("one", "/t1", {"title": " "}, ["MISSING_TITLE"]),
    ("one", "/t2", {"title": "Short"}, ["TITLE_TOO_SHORT"]),
    ("one", "/t3", {"title": "x" * 61}, ["TITLE_TOO_LONG"]),
    ("one", "/t4", {"title": "Home"}, ["TITLE_TOO_SHORT", "WEAK_GENERIC_TITLE"]),
    ("one", "/m1", {"meta_description": None}, ["MISSING_META_DESCRIPTION"]),
    ("one", "/m2", {"meta_description": "x" * 69}, ["META_DESC_TOO_SHORT"]),
    ("one", "/m3", {"meta_description": "x" * 161}, ["META_DESC_TOO_LONG"]),
    ("one", "/h1", {"h1_list": []}, ["MISSING_H1", "A11Y_MISSING_H1"]),
    ("one", "/h2", {"h1_list": ["a", "b"]}, ["MULTIPLE_H1"]),
    ("one", "/h3", {"headings": [(1, "a"), (3, "b")]}, ["BROKEN_HEADING_HIERARCHY"]),
    ("one", "/s1", {"status_code": 503}, ["SERVER_ERROR_5XX"]),
    ("one", "/s2", {"status_code": 404}, ["PAGE_NOT_FOUND_4XX"]),
    ("one", "/c1", {"canonical_url": ""}, ["MISSING_CANONICAL"]),
    ("one", "/c2", {"canonical_url": _U + "/other"}, ["CANONICAL_MISMATCH"]),
    ("one", "/c3", {"canonical_url": "no address"}, ["INVALID_CANONICAL"]),
    ("one", "/r1", {"robots_directives": "NOINDEX, follow"}, ["NOINDEX_DIRECTIVE"]),
    ("one", "/w1", {"word_count": 299}, ["THIN_CONTENT"]),
    ("one", "/i1", {"images": [("p.png", "", None, None), ("q.png", "q", None, None)]}, ["IMAGES_MISSING_ALT", "A11Y_IMAGES_MISSING_ALT"]),
    ("one", "/l1", {"internal_links": []}, ["NO_INTERNAL_OUTBOUND_LINKS"]),
    ("one", "/l2", {"internal_links": [(_U + "/", " Click Here ", None, None)]}, ["NON_DESCRIPTIVE_ANCHOR"]),
    ("one", "/" + "x" * 100, {}, ["URL_TOO_LONG"]),
    ("one", "/Upper", {}, ["URL_HAS_UPPERCASE"]),
    ("one", "/under_score", {}, ["URL_HAS_UNDERSCORES"]),
    ("one", "/q?a=1&b=2&c=3&d=4", {}, ["EXCESSIVE_URL_PARAMETERS"]),
    ("one", "/d1", {"has_structured_data": False}, ["MISSING_STRUCTURED_DATA"]),
    ("one", "/f1", {"flesch_score": 44}, ["POOR_READABILITY"]),
    ("one", "/n1", {"url": "http://a.example/n1"}, ["NO_HTTPS"]),
    ("one", "/x1", {"ssl_valid": False}, ["INVALID_SSL_CERT"]),
    ("one", "/x2", {"ssl_valid": True, "ssl_days_remaining": 14}, ["SSL_EXPIRING_SOON"]),
    ("one", "/x3", {"mixed_content": ["http://a.example/p.png"]}, ["MIXED_CONTENT"]),
    ("one", "/x4", {"security_headers": (False, False, False, False, False)}, ["MISSING_HSTS", "MISSING_X_CONTENT_TYPE", "MISSING_X_FRAME_OPTIONS"]),
    # over several pages
    ("two", "/", {}, []),
    ("two", "/a", {"title": "The same title on two pages of it"}, ["DUPLICATE_TITLE"]),
    ("two", "/b", {"title": "the same title on TWO pages of it "}, ["DUPLICATE_TITLE"]),
    ("two", "/c", {"meta_description": "One description that two pages of this scan have, so it is said twice."}, ["DUPLICATE_META_DESCRIPTION"]),
    ("two", "/d", {"meta_description": "One description that two pages of this scan have, so it is said twice."}, ["DUPLICATE_META_DESCRIPTION"]),
    ("two", "/gone", {"status_code": 410}, ["PAGE_NOT_FOUND_4XX"]),
    ("two", "/e", {"internal_links": [(_U + "/gone", "Gone page", None, None)]}, ["BROKEN_INTERNAL_LINK"]),
    ("two", "/f", {"internal_links": [(_U + "/a", "Page a", None, 2)]}, ["REDIRECT_CHAIN"]),
    ("two", "/g", {"external_links": [("https://o.example/x", "x", 404), ("https://o.example/y", "y", 200)]}, ["BROKEN_EXTERNAL_LINK"]),
    ("two", "/h", {"body_text": _TEXT}, ["EXACT_DUPLICATE_CONTENT"]),
    ("two", "/i", {"body_text": _TEXT.upper() + " !"}, ["EXACT_DUPLICATE_CONTENT"]),
    # platforms
    ("shop", "/", {"body_text": "cdn.shopify.com"}, []),
    ("shop", "/collections/c/products/p", {}, ["SHOPIFY_COLLECTION_PRODUCT_DUPLICATE", "MISSING_PRODUCT_SCHEMA"]),
    ("shop", "/x?variant=1", {}, ["SHOPIFY_VARIANT_PARAM_BLOAT"]),
    ("press", "/", {"body_text": "/wp-content/a"}, []),
    ("press", "/attachment/5", {}, ["WORDPRESS_ATTACHMENT_PAGE_BLOAT"]),
]
#: Site-wide issues and vitals, from the inputs of ``audit_all_codes``: two orphans, no robots.txt, an empty sitemap, a probe's finding, one near duplicate, slow pages.
SITE = {"ORPHAN_PAGE": 2, "ROBOTS_TXT_MISSING": 1, "SITEMAP_MISSING_OR_EMPTY": 2, "BROKEN_EXTERNAL_LINK": 1, "NEAR_DUPLICATE_CONTENT": 1, "POOR_LCP": 1, "NEEDS_WORK_LCP": 1, "POOR_CLS": 1, "POOR_TBT": 1}


def _near(text: str) -> str:
    return text + " brook1"  # one bit of the hash differs


def fixture_pages(spark: SparkSession) -> DataFrame:
    rows = [_page(k, scan, path, **changes) for k, (scan, path, changes, _) in enumerate(CASES, 1)]
    rows += [_page(900, "near", "/n1", body_text=_TEXT), _page(901, "near", "/n2", body_text=_near(_TEXT))]
    return spark.createDataFrame(rows, FIELDS)


def _audited(spark: SparkSession) -> DataFrame:
    pages = fixture_pages(spark)
    roots = spark.createDataFrame([(s, _U + "/") for s in ("one", "two", "shop", "press", "near")], "scan_id string, root_url string")
    listed = spark.createDataFrame([("two", _U + "/lost", 0), ("two", _U + "/gone/?utm_source=x", 1), ("two", _U + "/", 2), ("press", _U + "/lost too", 0)], "scan_id string, url string, ord int")
    own_files = spark.createDataFrame([("one", True, True, 5), ("two", False, True, 0), ("shop", True, False, None)], "scan_id string, robots_found boolean, sitemap_found boolean, sitemap_urls int")
    probe = spark.createDataFrame([("one", _U + "/", "https://p.example/", 500)], "scan_id string, url string, target_url string, status int")
    vitals = spark.createDataFrame([("one", 1, _U + "/", 4.1, 0.3, 601), ("one", 2, _U + "/t1", 2.6, 0.25, 600)], "scan_id string, page_id bigint, url string, lcp double, cls double, tbt int")
    return audit.audit(pages, roots, own_files, listed, probe, vitals)


def audit_all_codes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each of the 53 codes is found in the fixture's pages and site inputs."""
    return _audited(spark).groupBy("code").agg(F.count("*").alias("n"), F.count("message").alias("n_messages"), F.min(F.length("message")).alias("shortest") > 0).toDF("code", "n", "n_messages", "worded")


def _expected_codes() -> dict[str, int]:
    out = dict(SITE)
    for _, _, _, codes in CASES:
        for code in codes:
            out[code] = out.get(code, 0) + 1
    return out


HTML = """<html><head><title> Tea  shop </title><meta name="Description" content=" Fine tea "><meta property="og:description" content="other"><meta name="robots" content="NOINDEX"><link rel="canonical" href="/tea">
<script type="application/ld+json">{"@graph": [{"@type": "Store"}, {"@type": ["A", "B"]}]}</script><script src="http://cdn.example/x.js"></script></head><body><h1>Tea</h1><p>Green tea is
drunk hot.</p><h3></h3><h2>Kinds</h2><img src="http://a.example/p.png" alt=" leaf " width="20px"><img alt="none"><a href="/green?x=1#y">Green</a><a href="https://o.example/z" aria-label="Other"></a><a href="mailto:x@a.example">Mail</a>
<script>var hidden = 1</script><noscript>off</noscript></body></html>"""


def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Records of three pages: full mark-up, damaged structured data, plain text."""
    raw = [(1, "https://a.example/t", HTML, {"x-robots-tag": "NoFollow", "strict-transport-security": "max-age=1"}), (2, "https://a.example/u", '<script type="application/ld+json">{"@type": </script><h1>U</h1>', {}), (3, "http://a.example/v", "no mark-up", {})]
    got = extract.extract(spark.createDataFrame(raw, "page_id bigint, url string, html string, headers map<string,string>"))
    j = lambda c: F.to_json(c)
    return got.select(
        "page_id", "title", "meta_description", "robots_directives", "canonical_url", F.array_join("h1_list", "|").alias("h1s"), F.size("headings").alias("n_headings"), "body_text", "word_count", j("images").alias("images"),
        F.array_join(F.transform("internal_links", lambda x: F.concat_ws(" ", x["url"], x["anchor_text"])), "|").alias("inner"), F.array_join(F.transform("external_links", lambda x: F.concat_ws(" ", x["url"], x["anchor_text"])), "|").alias("outer"),
        "has_structured_data", F.array_join("structured_data_types", "|").alias("types"), F.array_join(F.coalesce("mixed_content", F.array().cast("array<string>")), "|").alias("mixed"), F.col("security_headers.hsts").alias("hsts"), F.col("security_headers.csp").alias("csp"),
    )


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nSitemap: https://a.example/map.xml\n"


def robots_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Which addresses robots.txt forbids; the longest pattern decides."""
    text = spark.createDataFrame([("a.example", ROBOTS), ("b.example", ""), ("c.example", None)], "host string, text string")
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h, p in [("a.example", "/"), ("a.example", "/private"), ("a.example", "/private/open/x"), ("a.example", "/x.pdf"), ("a.example", "/x.pdf?y=1"), ("b.example", "/private"), ("d.example", "/private")]], "url string")
    parts = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return files.disallowed(parts, files.robots_rules(text)).select("url", "disallowed")


def sitemap_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of an index of two sitemaps, one of them named twice, and of a robots.txt that names none."""
    robots = spark.createDataFrame([("a.example", ROBOTS), ("b.example", "")], "host string, text string")
    loc = lambda kind, *us: "".join(f"<{kind}><loc> {u} </loc></{kind}>" for u in us)
    xml = [
        ("https://a.example/map.xml", f"<sitemapindex>{loc('sitemap', 'https://a.example/1.xml', 'https://a.example/2.xml', 'https://a.example/1.xml', 'https://a.example/none.xml')}</sitemapindex>"),
        ("https://a.example/1.xml", f"<urlset>{loc('url', 'https://a.example/x', 'https://a.example/y')}</urlset>"), ("https://a.example/2.xml", f"<urlset>{loc('url', 'https://a.example/y', 'https://a.example/z')}</urlset>"),
        ("https://b.example/sitemap.xml", f"<urlset>{loc('url', 'https://b.example/')}</urlset>"),
    ]
    found = files.sitemap_urls(files.sitemap_lines(robots), spark.createDataFrame(xml, "sitemap_url string, xml string"))
    return found.select("root", "url", F.col("ord").cast("bigint").alias("ord"))


def page_speed_vitals(spark: SparkSession, folder: str) -> DataFrame:
    """Measured vitals of two answers, the second without audits, and estimates where nothing was measured."""
    target = cut_folder(spark)
    answer = {"id": "https://a.example/", "lighthouseResult": {"finalUrl": "https://a.example/home", "categories": {"performance": {"score": 0.555}}, "audits": {
        "largest-contentful-paint": {"numericValue": 3456.0}, "interaction-to-next-paint": {"numericValue": 99.5}, "cumulative-layout-shift": {"numericValue": 0.1234}, "first-contentful-paint": {"numericValue": 1000.0},
        "total-blocking-time": {"numericValue": 250.4}, "unused-javascript": {"score": 0.5, "title": "Less code", "displayValue": "1 s"}, "modern-image-formats": {"score": 0.95, "title": "x"}}}}
    spark.createDataFrame([(json.dumps(answer),), (json.dumps({"id": "https://b.example/", "lighthouseResult": {}}),)], "value string").coalesce(1).write.text(target)
    got = files.page_speed(spark, target)
    return got.select("url", "perf_score", "lcp", "inp", "cls", "fcp", "tbt", F.array_join(F.transform("opportunities", lambda o: F.concat_ws(": ", o["title"], o["savings"])), "|").alias("opportunities"))


def chosen_vitals(spark: SparkSession, folder: str) -> DataFrame:
    """Measured vitals go before estimated ones."""
    pages = spark.createDataFrame([(1, 500, [], 500), (2, 2000, [("p", None, None, None)] * 9, 100)], "page_id bigint, response_time_ms int, images array<struct<src:string,alt:string,width:int,height:int>>, word_count int")
    measured = spark.createDataFrame([(1, 42, 1.0, 0.5, 0.0, 10, 20)], "page_id bigint, perf_score int, lcp double, fcp double, cls double, tbt int, inp int")
    return requests.vitals(pages, measured).select("page_id", "perf_score", "lcp", "fcp", "cls", "tbt", "inp", "source")


def search_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a stored search report as they are shown."""
    target = cut_folder(spark)
    report = {"rows": [{"keys": ["tea"], "clicks": 3, "impressions": 9, "ctr": 0.33333, "position": 2.25}, {"keys": [], "clicks": 0, "impressions": 0, "ctr": 0, "position": 0}]}
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.text(target)
    return search.shaped(files.search_report(spark, target))


def stored_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table after the fixture's audit was written and read again, twice appended."""
    pages, target = fixture_pages(spark).where("scan_id = 'shop'"), cut_folder(spark)
    found = audit.issue_rows(audit.audit(pages, spark.createDataFrame([("shop", _U + "/")], "scan_id string, root_url string")))
    recs = sinks.recommendation_rows(recommend.recommendations(found))
    out = None
    for name, rows in {"pages": sinks.page_rows(pages), "links": sinks.link_rows(pages), "issues": found, "recommendations": recs}.items():
        for _ in range(2):
            sinks.append(rows, f"{target}/{name}")
        back = spark.read.parquet(f"{target}/{name}").agg(F.count("*").alias("n"), F.countDistinct("scan_id").alias("scans")).select(F.lit(name).alias("name"), "n", "scans")
        out = back if out is None else out.unionByName(back)
    return out


def platform_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations for a shop and for a site of no known platform, from the same two issues."""
    rows = [(f"{s}{k}", s, k, "technical", c, v, t) for s in ("p", "q") for k, (c, v, t) in enumerate([("DUPLICATE_TITLE", "high", "Title used more than once"), ("OWN_RULE", "low", "Own rule")], 1)]
    issues = spark.createDataFrame(rows, "issue_id string, scan_id string, page_id bigint, category string, code string, severity string, title string")
    on = spark.createDataFrame([("p", "shopify")], "scan_id string, platform string")
    urls = spark.createDataFrame([(1, "https://a.example/1")], "page_id bigint, url string")
    got = recommend.recommendations(issues, platforms=on, urls=urls)
    return got.select("scan_id", "rank", "code", "platform", "problem", F.element_at("how_to_fix", 1).alias("first_step"), F.size("how_to_fix").alias("n_steps"), F.col("code_snippet.language").alias("language"), F.array_join("sample_pages", " ").alias("sample_pages"))


def _values(names: str, rows: list[tuple]) -> str:
    def cell(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def sql() -> dict[str, str]:
    """What each query must give."""
    body = "TeaGreen tea is drunk hot.KindsGreenMail"  # as browsers join the text of elements: without blanks of their own
    return {
        "audit_all_codes": _values("code, n, n_messages, worded", [(c, n, n, True) for c, n in sorted(_expected_codes().items())]),
        "extracted_pages": _values("page_id, title, meta_description, robots_directives, canonical_url, h1s, n_headings, body_text, word_count, images, \"inner\", \"outer\", has_structured_data, types, mixed, hsts, csp", [
            (1, "Tea  shop", "Fine tea", "noindex, nofollow", "https://a.example/tea", "Tea", 2, body, 5, '[{"src":"http://a.example/p.png","alt":"leaf","width":20}]', "https://a.example/green?x=1 Green", "https://o.example/z Other", True, "Store|A,B", "http://cdn.example/x.js|http://a.example/p.png", True, False),
            (2, None, None, None, None, "U", 1, "U", 1, "[]", "", "", False, "", "", False, False), (3, None, None, None, None, "", 0, "no mark-up", 2, "[]", "", "", False, "", "", False, False),
        ]),
        "robots_decisions": _values("url, disallowed", [("https://a.example/", False), ("https://a.example/private", True), ("https://a.example/private/open/x", False), ("https://a.example/x.pdf", True), ("https://a.example/x.pdf?y=1", True), ("https://b.example/private", False), ("https://d.example/private", False)]),
        "sitemap_addresses": _values("root, url, ord", [("https://a.example/map.xml", "https://a.example/x", 0), ("https://a.example/map.xml", "https://a.example/y", 1), ("https://a.example/map.xml", "https://a.example/z", 2), ("https://b.example/sitemap.xml", "https://b.example/", 0)]),
        "page_speed_vitals": _values("url, perf_score, lcp, inp, cls, fcp, tbt, opportunities", [("https://a.example/home", 56, 3.46, 100, 0.123, 1.0, 250, "Less code: 1 s"), ("https://b.example/", 0, 0.0, 0, 0.0, 0.0, 0, "")]),
        # page 2: lcp 0.9 + 2 x 1.8 + 9 x 0.05; fcp 0.6 + 2 x 1.3; nine images move the layout by 0.14; tbt 60 + 100 / 25 + 9 x 14; lost 18 + 15 + 12 + 8
        "chosen_vitals": _values("page_id, perf_score, lcp, fcp, cls, tbt, inp, source", [(1, 42, 1.0, 0.5, 0.0, 10, 20, "measured"), (2, 47, 4.95, 3.2, 0.14, 190, 208, "estimated")]),
        "search_rows": _values("key, clicks, impressions, ctr, position", [("tea", 3.0, 9.0, 33.33, 2.3), (None, 0.0, 0.0, 0.0, 0.0)]),
        # four pages with a link each but for one page's own; issues and recommendations as audit_all_codes counts them for this scan
        "stored_tables": _values("name, n, scans", [("pages", 6, 1), ("links", 6, 1), ("issues", 10, 1), ("recommendations", 8, 1)]),
        "platform_steps": _values("scan_id, rank, code, platform, problem, first_step, n_steps, language, sample_pages", [
            ("p", 1, "DUPLICATE_TITLE", "shopify", "1 pages have no title of their own.", "Open the product or page in the shop's administration.", 3, "html", "https://a.example/1"), ("p", 2, "OWN_RULE", "shopify", "1 cases of: Own rule", "Look at the pages listed.", 2, None, ""),
            ("q", 1, "DUPLICATE_TITLE", "custom", "1 pages have no title of their own.", "Open the template of the page.", 2, "html", "https://a.example/1"), ("q", 2, "OWN_RULE", "custom", "1 cases of: Own rule", "Look at the pages listed.", 2, None, ""),
        ]),
    }


QUERIES = {f.__name__: f for f in (audit_all_codes, extracted_pages, robots_decisions, sitemap_addresses, page_speed_vitals, chosen_vitals, search_rows, stored_tables, platform_steps)}
