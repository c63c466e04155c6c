import json

import pytest

from sitelens.operators import scores, site_rules
from sitelens.operators.rules import PAGE, Registry, page_issues
from sitelens.functions.urls import normal_url


def codes(df):
    return sorted(r.code for r in df.collect())


def only(make_pages, **change):
    return codes(page_issues(make_pages(change)))


def test_a_faultless_page_has_no_issues(make_pages):
    assert only(make_pages) == []


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"title": ""}, "MISSING_TITLE"), ({"title": " "}, "MISSING_TITLE"), ({"title": "x" * 29}, "TITLE_TOO_SHORT"), ({"title": "x" * 61}, "TITLE_TOO_LONG"), ({"meta_description": None}, "MISSING_META_DESCRIPTION"), ({"meta_description": "x" * 69}, "META_DESC_TOO_SHORT"),
        ({"meta_description": "x" * 161}, "META_DESC_TOO_LONG"), ({"h1_list": ["a", "b"]}, "MULTIPLE_H1"), ({"status_code": 404}, "PAGE_NOT_FOUND_4XX"), ({"status_code": 500}, "SERVER_ERROR_5XX"), ({"canonical_url": None}, "MISSING_CANONICAL"),
        ({"canonical_url": "https://example.com/other"}, "CANONICAL_MISMATCH"), ({"canonical_url": "nonsense"}, "INVALID_CANONICAL"), ({"robots_directives": "NOINDEX"}, "NOINDEX_DIRECTIVE"), ({"word_count": 299}, "THIN_CONTENT"), ({"internal_links": []}, "NO_INTERNAL_OUTBOUND_LINKS"),
        ({"internal_links": [("u", " Click Here ", None, None)]}, "NON_DESCRIPTIVE_ANCHOR"), ({"has_structured_data": False}, "MISSING_STRUCTURED_DATA"), ({"flesch_score": 44}, "POOR_READABILITY"), ({"ssl_valid": False}, "INVALID_SSL_CERT"), ({"ssl_valid": True, "ssl_days_remaining": 14}, "SSL_EXPIRING_SOON"),
        ({"mixed_content": ["http://a"]}, "MIXED_CONTENT"), ({"headings": [(2, "a"), (3, "b"), (5, "c")]}, "BROKEN_HEADING_HIERARCHY"),
    ],
)
def test_each_rule(make_pages, change, code):
    assert only(make_pages, **change) == [code]


@pytest.mark.parametrize("change", [{"title": "x" * 30}, {"title": "x" * 60}, {"meta_description": "x" * 70}, {"meta_description": "x" * 160}, {"word_count": 300}, {"flesch_score": 45}, {"status_code": 399}, {"ssl_valid": True, "ssl_days_remaining": 15}, {"ssl_valid": True, "ssl_days_remaining": 0}, {"headings": [(3, "a"), (1, "b"), (4, "c")]}, {"canonical_url": "https://other.com/test"}])
def test_bounds_that_pass(make_pages, change):
    assert only(make_pages, **change) == []


def test_rules_of_several_codes(make_pages):
    assert only(make_pages, h1_list=[]) == ["A11Y_MISSING_H1", "MISSING_H1"]
    assert only(make_pages, title="Home") == ["TITLE_TOO_SHORT", "WEAK_GENERIC_TITLE"]
    found = page_issues(make_pages({"images": [("a", None, None, None), ("b", "", None, None), ("c", "x", None, None)]}))
    assert codes(found) == ["A11Y_IMAGES_MISSING_ALT", "IMAGES_MISSING_ALT"]
    assert json.loads(found.where("code = 'IMAGES_MISSING_ALT'").first().detail) == {"count": 2, "sampleImages": ["a", "b"]}
    secured = (False, True, False, False, False)
    assert only(make_pages, security_headers=secured) == ["MISSING_HSTS", "MISSING_X_CONTENT_TYPE"]
    url = "http://example.com/A_b?" + "&".join(f"k{i}=1" for i in range(40))
    assert {"NO_HTTPS", "URL_TOO_LONG", "URL_HAS_UPPERCASE", "URL_HAS_UNDERSCORES", "EXCESSIVE_URL_PARAMETERS"} <= set(only(make_pages, url=url))


def test_nulls_everywhere_and_an_empty_table(spark, make_pages):
    nothing = make_pages({k: None for k in ("url", "final_url", "status_code", "title", "meta_description", "h1_list", "headings", "canonical_url", "robots_directives", "word_count", "body_text", "images", "internal_links", "external_links", "depth", "headers", "has_structured_data", "structured_data_types", "flesch_score")})
    assert set(codes(page_issues(nothing))) == {"MISSING_TITLE", "MISSING_META_DESCRIPTION", "MISSING_H1", "MISSING_CANONICAL", "NO_HTTPS"}
    assert page_issues(nothing.limit(0)).count() == 0
    for f in (site_rules.duplicate_titles, site_rules.broken_internal_links, site_rules.redirect_chains, site_rules.platforms):
        f(nothing).collect()
        assert f(nothing.limit(0)).count() == 0


def test_one_scan_of_the_pages(make_pages):
    plan = page_issues(make_pages({}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Exchange" not in plan and len(PAGE.rules) == 35


def test_own_registry(make_pages):
    from pyspark.sql import functions as F

    own = Registry()

    @own.rule("DEEP", "onpage", "low", "Deep page")
    def deep():
        return F.col("depth") > 5

    assert codes(page_issues(make_pages({"depth": 6}, {"depth": 5}), own)) == ["DEEP"]


def test_duplicates_broken_links_and_chains(make_pages):
    p = make_pages({"title": "Same title of two pages in here"}, {"title": " same Title of two pages in here", "url": "https://example.com/b", "final_url": "https://example.com/c", "status_code": 404}, {"title": "Another", "url": "https://example.com/d", "final_url": "https://example.com/d", "internal_links": [("https://example.com/c", "x", None, 3), ("https://example.com/d", "y", None, 1)], "external_links": [("https://o.com", "z", 404), ("https://o.com/2", "z", 399)]})
    dup = site_rules.duplicate_titles(p).collect()
    assert len(dup) == 2 and json.loads(dup[0].detail)["sharedUrls"] == ["https://example.com/test", "https://example.com/b"]
    broken = site_rules.broken_internal_links(p).collect()
    assert [json.loads(b.detail)["targetStatus"] for b in broken] == [404]
    assert site_rules.redirect_chains(p).count() == 1 and site_rules.broken_external_links(p).count() == 1


def test_orphans_keep_repeats_and_leave_the_root(spark, make_pages):
    p = make_pages({"internal_links": [("https://example.com/a/?utm_source=x", "a", None, None)]})
    listed = spark.createDataFrame([("s", "https://example.com/", 0), ("s", "https://example.com/a", 1), ("s", "https://example.com/b", 2), ("s", "https://example.com/b", 3)], "scan_id string, url string, ord int")
    roots = spark.createDataFrame([("s", "https://example.com")], "scan_id string, root_url string")
    found = site_rules.orphans(listed, p, roots, normal_url)
    assert [r.url for r in found.collect()] == ["https://example.com/b"] * 2
    assert site_rules.orphan_issues(found, 1).count() == 1


def test_exact_and_near_duplicates(make_pages):
    text = " ".join(f"word{i} thing{i * 7} place{i * 3}" for i in range(60))
    p = make_pages({"body_text": text, "url": "https://e.com/1"}, {"body_text": text.upper() + "!", "url": "https://e.com/2"}, {"body_text": text + " and one more end", "url": "https://e.com/3"}, {"body_text": "short"}, {"body_text": None})
    exact = site_rules.duplicate_content(p).collect()
    assert sorted(r.page_id for r in exact) == [1, 2]
    near = site_rules.near_duplicate_content(p).collect()
    assert {json.loads(r.detail)["urlB"] for r in near} <= {"https://e.com/3"}


@pytest.mark.parametrize(("body", "url", "platform"), [("cdn.shopify.com", "https://e.com/collections/a/products/b", "shopify"), ("/wp-content/x", "https://e.com", "wordpress"), ("__NEXT_DATA__", "https://e.com", "nextjs"), ("woocommerce /wp-content/", "https://e.com", "woocommerce"), ("plain", "https://e.com", "custom")])
def test_platforms(make_pages, body, url, platform):
    row = site_rules.platforms(make_pages({"body_text": body, "url": url})).first()
    assert row.platform == platform and row.confidence == (50 if platform == "custom" else min(100, row.confidence)) and row.confidence >= 40


def test_two_product_urls_make_a_shop(make_pages):
    row = site_rules.platforms(make_pages({"url": "https://e.com/products/1"}, {"url": "https://e.com/products/2"})).first()
    assert (row.platform, row.confidence) == ("shopify", 80)


def test_platform_rules(make_pages):
    mark = {"body_text": "cdn.shopify.com", "structured_data_types": []}
    p = make_pages({**mark, "url": "https://e.com/collections/a/products/b", "canonical_url": "https://e.com/collections/a/products/b"}, {**mark, "url": "https://e.com/x?variant=1"})
    assert codes(site_rules.platform_issues(p, site_rules.platforms(p))) == ["MISSING_PRODUCT_SCHEMA", "SHOPIFY_COLLECTION_PRODUCT_DUPLICATE", "SHOPIFY_VARIANT_PARAM_BLOAT"]


def test_vitals(spark, make_pages):
    row = site_rules.estimated_vitals(make_pages({"response_time_ms": 500, "images": [], "word_count": 500}), "page_id").first()
    assert (row.lcp, row.fcp, row.cls, row.tbt, row.inp, row.perf_score) == (1.8, 1.25, 0.02, 80, 100, 99)
    m = spark.createDataFrame([(1, 4.01, 0.26, 601), (2, 4.0, 0.25, 600), (3, 2.5, None, None)], "k int, lcp double, cls double, tbt int")
    assert sorted((r.k, r.code) for r in site_rules.vitals_issues(m, "k").collect()) == [(1, "POOR_CLS"), (1, "POOR_LCP"), (1, "POOR_TBT"), (2, "NEEDS_WORK_LCP")]


def issues(spark, *rows):
    return spark.createDataFrame([("s", i, *r, f"t{i}") for i, r in enumerate(rows)] or [], "scan_id string, issue_ord int, category string, code string, severity string, title string")


def scored(spark, perf, *rows, **how):
    return scores.scores(spark.createDataFrame([("s", perf)], "scan_id string, perf_score int"), issues(spark, *rows), **how).first()


def test_scores(spark):
    assert scored(spark, None)[1:] == (100, 100, 100, 100, 100, 100, "A")
    row = scored(spark, None, ("technical", "A", "critical"), ("technical", "B", "high"), ("onpage", "C", "medium"), ("onpage", "D", "low"))
    assert (row.technical, row.onpage, row.overall, row.grade) == (77, 95, 92, "A")
    row = scored(spark, None, *[("technical", "A", "critical")] * 5)
    assert (row.technical, row.overall, row.grade) == (25, 78, "B")
    assert scored(spark, None, *[("technical", "A", "critical")] * 50).technical == 0
    assert scored(spark, 70).performance == 55 and scored(spark, 70, ("performance", "P", "high")).performance == 51 and scored(spark, 70, blend=False).performance == 70


def test_grades_and_deductions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in (90, 89, 75, 74, 60, 59, 45, 44, None)], "n int").select(scores.grade(F.col("n")))
    assert [r[0] for r in df.collect()] == ["A", "B", "B", "C", "C", "D", "D", "F", None]
    found = scores.deductions(issues(spark, ("technical", "B", "low"), ("technical", "A", "low"), ("technical", "C", "high"), ("technical", "B", "medium"))).orderBy("rank").collect()
    assert [(r.code, r.deduction, r.title) for r in found] == [("C", 8, "t2"), ("B", 5, "t0"), ("A", 1, "t1")]
    assert scores.severity_counts(issues(spark, ("x", "y", "low"), ("x", "y", None))).first()[1:] == (2, 0, 0, 0, 1)


def test_every_issue_has_those_of_texts_orphans_platforms_and_vitals(spark, make_pages):
    from collections import Counter

    from sitelens.plans.audit_queries import every_issue, page_and_link_issues

    text = "The same long text stands on two pages of this shop, cdn.shopify.com serves its pictures to all of them."
    u = "https://example.com"
    p = make_pages(*({"url": u + path, "final_url": u + path, "title": f"A title of a fitting length, number {k}", "body_text": text, "structured_data_types": None} for k, path in enumerate(["/", "/products/a?variant=1"])))
    roots = spark.createDataFrame([("s", u + "/")], "scan_id string, root_url string")
    vitals = spark.createDataFrame([("s", 1, u + "/", 5.0, 0.3, 700), ("s", 2, u + "/products/a", 3.0, 0.0, 0)], "scan_id string, page_id bigint, url string, lcp double, cls double, tbt int")
    got, narrow = Counter(r.code for r in every_issue(p, roots, vitals).collect()), Counter(r.code for r in page_and_link_issues(p).collect())
    assert got - narrow == {"EXACT_DUPLICATE_CONTENT": 2, "ORPHAN_PAGE": 1, "SHOPIFY_VARIANT_PARAM_BLOAT": 1, "MISSING_PRODUCT_SCHEMA": 1, "POOR_LCP": 1, "NEEDS_WORK_LCP": 1, "POOR_CLS": 1, "POOR_TBT": 1}


def test_messages_name_what_was_found(make_pages):
    p = make_pages({"title": "Short", "word_count": 12, "headings": [(1, "a"), (4, "b")]})
    said = {r.code: r.message for r in page_issues(p).collect()}
    assert said["TITLE_TOO_SHORT"].startswith("The title has 5 characters") and "12 words" in said["THIN_CONTENT"] and said["BROKEN_HEADING_HIERARCHY"] == "A heading of level 4 follows one of level 1."
    every = page_issues(make_pages({k: None for k in ("url", "title", "h1_list", "canonical_url", "meta_description")})).collect()
    assert every and all(r.message for r in every)


def test_all_members_of_a_group_as_rows(spark, make_pages):
    p = make_pages(*({"title": "One title for all of these pages", "url": f"https://e.com/{k}", "page_ord": 250_000 - k * 70_000 if k else None} for k in range(4)))
    found = site_rules.duplicate_field(p, "title")
    rows = site_rules.group_rows(found, ["scan_id", "norm"]).orderBy("ord").collect()
    assert [(r.ord, r.url[-1]) for r in rows] == [(0, "0"), (1, "3"), (2, "2"), (3, "1")]


def test_first_pairs_of_large_groups_of_copies(spark, make_pages):
    """Two hashes of many copies each: the first pairs equal those of all pairs."""
    from sitelens.operators.duplicates import near_pairs

    text = " ".join(f"stone{i} river{i * 7} cloud{i * 3}" for i in range(60))
    p = make_pages(*({"body_text": text + (" brook1" if k % 3 else ""), "url": f"https://e.com/{k}"} for k in range(30)))
    every = sorted((r.ord_a, r.ord_b) for r in near_pairs(p, ["scan_id"]).collect())
    assert len(every) == 200
    found = [(json.loads(r.detail)["urlA"], json.loads(r.detail)["urlB"]) for r in site_rules.near_duplicate_content(p).collect()]
    assert sorted(found) == sorted((f"https://e.com/{a}", f"https://e.com/{b}") for a, b in every[:10])
