"""Queries over crawled pages, stored pages, issues, metrics and documents, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.text import bit_string, content_hash, reading_ease, shingles, simhash
from sitelens.functions.urls import normal_url, query_fields, url_host, url_path
from sitelens.operators import audit, crawl, duplicates, read_model, recommend, scores, search, site_rules
from sitelens.operators.rules import page_issues
from sitelens.session import cut
from sitelens.tables import latest, load, numbered

S, D = SparkSession, DataFrame


#: Columns the page rules read.
RULE_COLUMNS = [
    "status_code", "title", "meta_description", "h1_list", "headings", "canonical_url", "robots_directives", "word_count", "images", "internal_links", "depth", "has_structured_data", "flesch_score", "ssl_valid", "ssl_days_remaining", "mixed_content", "security_headers",
]


def _read(spark: S, folder: str, table: str, key: str, columns: tuple[str, ...]) -> D:
    """The counting rows with these columns only: they are chosen before the shuffle, so the scan reads no more."""
    return latest(load(spark, folder, table).select(*dict.fromkeys([key, *columns, "ingested_at"])), key)


def pages(spark: S, folder: str, *columns: str) -> D:
    """Crawled pages with their keys and ``columns``."""
    return _read(spark, folder, "crawled_pages", "page_id", ("scan_id", "page_ord", "url", *columns))


def stored(spark: S, folder: str, *columns: str) -> D:
    """Stored pages with scan, URL and ``columns``."""
    return _read(spark, folder, "site_pages", "page_id", ("scan_id", "url", *columns))


def documents(spark: S, folder: str) -> D:
    return _read(spark, folder, "documents", "doc_id", ("text", "url"))


def issues(spark: S, folder: str, *columns: str) -> D:
    """Stored issues with categories in one spelling."""
    return _read(spark, folder, "issues", "issue_id", ("scan_id", "page_id", "category", "code", "severity", *columns)).withColumn("category", F.lower("category"))


def scans(spark: S, folder: str, *columns: str) -> D:
    return _read(spark, folder, "scans", "scan_id", ("root_url", *columns))


def _numbered(each: D, others: list[D], first: int) -> D:
    for n, df in enumerate(others):
        each = each.unionByName(df.withColumn("issue_ord", F.lit(first + n)))
    return each


def page_and_link_issues(p: D) -> D:
    """The issues of the page rules, of titles and descriptions used more than once, and of links; issue_ord keeps the order of evaluation."""
    each = page_issues(p).drop("page_ord")
    return _numbered(each, [site_rules.duplicate_titles(p), site_rules.duplicate_descriptions(p), site_rules.broken_internal_links(p), site_rules.redirect_chains(p), site_rules.broken_external_links(p)], 1000)


def every_issue(p: D, roots: D, measured: D) -> D:
    """Every issue of crawled pages. ``roots`` has (scan_id, root_url), ``measured`` the vitals with scan_id, page_id and url. Crawled pages
    are taken as their scan's sitemap; the site's own files and a probe of outer links are not in the tables.
    """
    return audit.audit(p, roots, measured=measured)


def found_issues(spark: S, folder: str) -> D:
    """Every issue the page rules, the rules over several pages, the platform rules and the vitals rules find."""
    # eleven rules read the pages: the rows that count are told apart once
    p = cut(pages(spark, folder, *RULE_COLUMNS, "final_url", "external_links", "body_text", "headers", "structured_data_types"))
    m = load(spark, folder, "page_metrics").dropDuplicates(["metric_id"]).select("page_id", "lcp", "cls", "tbt")
    return every_issue(p, scans(spark, folder), m.join(stored(spark, folder).hint("merge"), "page_id", "left"))


def page_issue_rows(spark: S, folder: str) -> D:
    return page_issues(pages(spark, folder, *RULE_COLUMNS)).select("page_id", "code", "category", "severity")


def heading_jumps(spark: S, folder: str) -> D:
    found = page_issues(pages(spark, folder, *RULE_COLUMNS)).where("code = 'BROKEN_HEADING_HIERARCHY'")
    j = F.from_json("detail", "jumpedFrom int, jumpedTo int")
    return found.select("page_id", j["jumpedFrom"].alias("jumped_from"), j["jumpedTo"].alias("jumped_to"))


def issue_code_counts(spark: S, folder: str) -> D:
    """Counts of the issues of the page rules, of shared titles and descriptions, and of links only; ``found_issue_counts`` has all."""
    p = pages(spark, folder, *RULE_COLUMNS, "final_url", "external_links")
    return page_and_link_issues(p).groupBy("code", "severity").agg(F.count("*").alias("n"))


def found_issue_counts(spark: S, folder: str) -> D:
    """Counts of every issue found, those of texts, orphans, platforms and vitals included."""
    return found_issues(spark, folder).groupBy("code", "severity").agg(F.count("*").alias("n"))


def duplicate_titles(spark: S, folder: str) -> D:
    return site_rules.duplicate_field(pages(spark, folder, "title"), "title").select("page_id", "n")


def duplicate_descriptions(spark: S, folder: str) -> D:
    return site_rules.duplicate_field(pages(spark, folder, "meta_description"), "meta_description", 10).select("page_id", "n")


def links_exploded(spark: S, folder: str) -> D:
    return site_rules.links(pages(spark, folder, "internal_links")).select("page_id", "link_ord", "target_url", "anchor_text")


def link_counts(spark: S, folder: str) -> D:
    p = pages(spark, folder, "internal_links", "external_links", "images")
    return p.select("page_id", F.coalesce(F.size("internal_links"), F.lit(0)).alias("n_internal"), F.coalesce(F.size("external_links"), F.lit(0)).alias("n_external"), F.coalesce(F.size(F.filter("images", lambda i: i["alt"].isNull() | (F.trim(i["alt"]) == ""))), F.lit(0)).alias("n_no_alt"))


def broken_links(spark: S, folder: str) -> D:
    found = site_rules.broken_internal_links(pages(spark, folder, "internal_links", "final_url", "status_code"))
    d = F.from_json("detail", "targetUrl string, targetStatus int")
    return found.select("page_id", d["targetUrl"].alias("target_url"), d["targetStatus"].alias("target_status"))


def external_broken(spark: S, folder: str) -> D:
    d = F.from_json("detail", "target string, status int")
    return site_rules.broken_external_links(pages(spark, folder, "external_links")).select("page_id", d["target"].alias("target_url"), d["status"].alias("status"))


def redirected(spark: S, folder: str) -> D:
    d = F.from_json("detail", "target string, hops int")
    return site_rules.redirect_chains(pages(spark, folder, "internal_links")).select("page_id", d["target"].alias("target_url"), d["hops"].alias("hops"))


def orphan_pages(spark: S, folder: str) -> D:
    """Crawled pages, taken as their scan's sitemap, that no page of the scan links to."""
    p = pages(spark, folder, "internal_links")
    listed = p.select("scan_id", "url", "page_id", F.col("page_ord").alias("ord"))
    return site_rules.orphans(listed, p, scans(spark, folder), normal_url).select("scan_id", "page_id", "url")


def platforms(spark: S, folder: str) -> D:
    return site_rules.platforms(pages(spark, folder, "body_text", "headers", "images", "internal_links")).select("scan_id", "platform", "confidence", F.array_join("signals", ",").alias("signals"))


def platform_rules(spark: S, folder: str) -> D:
    p = pages(spark, folder, "body_text", "headers", "images", "internal_links", "canonical_url", "structured_data_types")
    return site_rules.platform_issues(p, site_rules.platforms(p)).select("page_id", "code")


def exact_duplicates(spark: S, folder: str) -> D:
    docs = documents(spark, folder)
    return duplicates.exact_groups(docs, (), "text", "doc_id", "doc_id").withColumnRenamed("first", "first_doc")


def duplicate_content(spark: S, folder: str) -> D:
    return site_rules.duplicate_content(pages(spark, folder, "body_text")).select("page_id", "code")


def simhashes(spark: S, folder: str) -> D:
    docs = documents(spark, folder)
    return docs.select("doc_id", bit_string(simhash(F.col("text"))).alias("simhash"))


def near_hash_pairs(spark: S, folder: str) -> D:
    """Pairs of different SimHash values of documents at most 4 bits apart."""
    docs = documents(spark, folder)
    hashes = docs.where(F.length("text") >= duplicates.LEAST_CHARS).select(simhash(F.col("text")).alias("simhash"))
    pairs = duplicates.near_hashes(hashes, (), "simhash", 4)
    return pairs.select(F.least(bit_string(F.col("h_a")), bit_string(F.col("h_b"))).alias("hash_a"), F.greatest(bit_string(F.col("h_a")), bit_string(F.col("h_b"))).alias("hash_b"), F.col("distance").cast("int").alias("distance"))


def near_duplicate_pages(spark: S, folder: str) -> D:
    return duplicates.near_pairs(pages(spark, folder, "body_text"), ["scan_id"], 6).select("scan_id", "id_a", "id_b", F.col("distance").cast("int").alias("distance"), "similarity")


def near_duplicate_rule(spark: S, folder: str) -> D:
    """Near duplicates as the rule reports them: at most 3 bits apart, the first ten pairs of a scan."""
    return site_rules.near_duplicate_content(pages(spark, folder, "body_text")).select("scan_id", "page_id", "code", F.get_json_object("detail", "$.urlB").alias("url_b"))


def shingle_counts(spark: S, folder: str) -> D:
    docs = documents(spark, folder)
    return docs.select("doc_id", F.size(shingles(F.col("text"))).alias("n_shingles"), content_hash(F.col("text")).alias("content_hash"))


def readability(spark: S, folder: str) -> D:
    docs = documents(spark, folder)
    return docs.select("doc_id", reading_ease(F.col("text")).alias("flesch"))


def url_quality(spark: S, folder: str) -> D:
    p = stored(spark, folder)
    path = url_path(F.col("url"))
    return p.select(
        "page_id", url_host(F.col("url")).alias("url_host"), path.alias("url_path"), (F.length("url") > 100).alias("long"), path.rlike("[A-Z]").alias("capitals"), path.contains("_").alias("underscores"), query_fields(F.col("url")).alias("n_fields")
    )


def normal_urls(spark: S, folder: str) -> D:
    """Pages of each scan by normalised URL, with the number of spellings."""
    p = stored(spark, folder).select("scan_id", "url", normal_url(F.col("url")).alias("normal_url"))
    return p.groupBy("scan_id", "normal_url").agg(F.count("*").alias("n"), F.countDistinct("url").alias("spellings"))


def vitals(spark: S, folder: str) -> D:
    return site_rules.estimated_vitals(pages(spark, folder, "response_time_ms", "images", "word_count"), "page_id").drop("n_opportunities").withColumns({"lcp": F.round(F.col("lcp") * 100).cast("int"), "fcp": F.round(F.col("fcp") * 100).cast("int"), "cls": F.round(F.col("cls") * 100).cast("int")})


def vitals_issues(spark: S, folder: str) -> D:
    m = load(spark, folder, "page_metrics").dropDuplicates(["metric_id"])
    return site_rules.vitals_issues(m, "metric_id").select("metric_id", "code", "severity")


def metric_defaults(spark: S, folder: str) -> D:
    return read_model.metric_view(load(spark, folder, "page_metrics").dropDuplicates(["metric_id"]))


def opportunities(spark: S, folder: str) -> D:
    m = load(spark, folder, "page_metrics").dropDuplicates(["metric_id"])
    return m.select("metric_id", F.coalesce(F.json_array_length("opportunities"), F.lit(0)).alias("n_opportunities"))


def opportunity_rows(spark: S, folder: str) -> D:
    """What could make each crawled page faster by the estimate, as rows with title and savings."""
    p = pages(spark, folder, "response_time_ms", "images", "word_count")
    return site_rules.estimated_opportunities(p, "page_id").select("page_id", "ord", "kind", "savings_ms")


def severity_pivot(spark: S, folder: str) -> D:
    return scores.severity_counts(issues(spark, folder))


def scan_scores(spark: S, folder: str) -> D:
    m = load(spark, folder, "page_metrics").groupBy("page_id").agg(F.min("perf_score").alias("perf_score"))
    by = stored(spark, folder).select("page_id", "scan_id").join(m, "page_id").groupBy("scan_id").agg(F.min("perf_score").alias("perf_score"))
    rows = scans(spark, folder).select("scan_id").join(by, "scan_id", "left")
    return scores.scores(rows, issues(spark, folder))


def top_deductions(spark: S, folder: str) -> D:
    numbered = issues(spark, folder, "title").withColumnRenamed("issue_id", "issue_ord")
    return scores.deductions(numbered).select("scan_id", "rank", "category", "code", "severity", "deduction", "n")


def issue_group_urls(spark: S, folder: str) -> D:
    """All page URLs of each issue group, one row each, with the issue that gives their order; nothing is cut."""
    return read_model.issue_group_urls(issues(spark, folder), stored(spark, folder))


def shared_title_urls(spark: S, folder: str) -> D:
    """All pages of each title that several pages of a scan share, in page order."""
    found = site_rules.duplicate_field(pages(spark, folder, "title"), "title")
    return site_rules.group_rows(found, ["scan_id", "norm"]).select("scan_id", F.col("norm").alias("title"), "ord", "page_id", "url")


def scan_pages(spark: S, folder: str) -> D:
    """All stored pages of each scan in order, with their places."""
    p = stored(spark, folder, "page_ord")
    return numbered(p, ["scan_id"], "page_ord", "page_id").select("scan_id", "ord", "page_id")


def page_total(spark: S, folder: str) -> D:
    """The number of pages a search finds, for the list's pages."""
    found = read_model.page_search(stored(spark, folder, "title", "status_code"), "garden", 200)
    return read_model.total(found, size=50)


def issue_groups(spark: S, folder: str) -> D:
    return read_model.issue_groups(issues(spark, folder), stored(spark, folder)).select("scan_id", "rank", "code", "severity", "n", "n_urls")


def first_issues(spark: S, folder: str) -> D:
    return read_model.first_of_group(issues(spark, folder)).select("scan_id", "code", "rank", "issue_id")


def issues_with_pages(spark: S, folder: str) -> D:
    return read_model.issues_with_pages(issues(spark, folder), stored(spark, folder, "title", "status_code")).select("issue_id", "url", "status_code")


def issue_filter(spark: S, folder: str) -> D:
    return read_model.issue_list(issues(spark, folder), category="technical", severity="critical").select("issue_id", "scan_id", "code")


def page_search(spark: S, folder: str) -> D:
    return read_model.page_search(stored(spark, folder, "title", "status_code"), "Garden", "200").select("page_id", "url", "title")


def page_list(spark: S, folder: str) -> D:
    """The second page of fifty of all pages by depth, with the number of issues of each."""
    p = stored(spark, folder, "depth").select("page_id", "url", "depth")
    listed = read_model.paged(p, "depth", "page_id", page=2)
    return read_model.with_counts(listed, "page_id", n_issues=issues(spark, folder))


def recent_scans(spark: S, folder: str) -> D:
    return read_model.paged(scans(spark, folder, "status", "created_at").select("scan_id", "root_url", "status", "created_at"), F.desc("created_at"), "scan_id", size=20)


def scan_summary(spark: S, folder: str) -> D:
    return read_model.scan_summary(scans(spark, folder, "status", "overall_score"), stored(spark, folder), issues(spark, folder))


def export_issues(spark: S, folder: str) -> D:
    return read_model.export_issues(issues(spark, folder, "message"), stored(spark, folder), scans(spark, folder))


def root_pages(spark: S, folder: str) -> D:
    return read_model.root_page(stored(spark, folder, "page_ord"), scans(spark, folder)).select("scan_id", "page_id")


def nested_scans(spark: S, folder: str) -> D:
    return read_model.nested(scans(spark, folder), pages(spark, folder)).select("scan_id", "n_pages", F.try_element_at("pages", F.lit(1))["page_id"].alias("first_page"))


def pages_with_metrics(spark: S, folder: str) -> D:
    m = load(spark, folder, "page_metrics").dropDuplicates(["page_id"])
    return read_model.with_metrics(stored(spark, folder).select("page_id"), m).where("perf_score is not null").select("page_id", "perf_score", "tbt")


def recommendations(spark: S, folder: str) -> D:
    return recommend.recommendations(issues(spark, folder)).select("scan_id", "rank", "code", "phase", "priority", "effort", "affected")


def recommendation_texts(spark: S, folder: str) -> D:
    """What each recommendation says on the platform of its scan, with its first three pages."""
    on = site_rules.platforms(pages(spark, folder, "body_text", "headers", "images", "internal_links"))
    recs = recommend.recommendations(issues(spark, folder, "title"), platforms=on, urls=stored(spark, folder))
    return recs.select("scan_id", "rank", "code", "platform", "problem", F.size("how_to_fix").alias("n_steps"), F.col("code_snippet.language").alias("language"), F.array_join("sample_pages", " ").alias("sample_pages"))


def executive_summaries(spark: S, folder: str) -> D:
    on = site_rules.platforms(pages(spark, folder, "body_text", "headers", "images", "internal_links"))
    groups = read_model.issue_groups(issues(spark, folder), stored(spark, folder))
    return recommend.summary(scan_scores(spark, folder), groups, scans(spark, folder), on)


def action_plan(spark: S, folder: str) -> D:
    return recommend.plan(recommend.recommendations(issues(spark, folder)))


def weighted_mean(spark: S, folder: str) -> D:
    """Search-analytics totals on order lines: parts as keys, quantities as clicks, prices as positions."""
    rows = load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("clicks"), F.col("l_quantity").cast("int").alias("impressions"), F.floor("l_extendedprice").alias("position"))
    t = search.totals(rows, "flag")
    return t.select("flag", F.col("clicks").cast("bigint").alias("clicks"), F.col("impressions").cast("bigint").alias("impressions"), F.floor(F.col("ctr") * 100 + 0.5).cast("bigint").alias("ctr_hundredths"), F.floor(F.col("position") * 10 + 0.5).cast("bigint").alias("position_tenths"))


def crawl_levels(spark: S, folder: str) -> D:
    """The stored pages of each scan met from its first page over internal links, within the scan's own bounds of depth and pages."""
    p = pages(spark, folder, "internal_links")
    seeds = p.groupBy("scan_id").agg(F.min_by("url", F.struct("page_ord", "page_id")).alias("url")).select("scan_id", "url", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("seed_ord"))
    edges = site_rules.links(p).select("scan_id", "from_url", "link_ord", "target_url")
    return crawl.crawl_order(seeds, edges, bounds=scans(spark, folder, "max_depth", "max_pages"))


QUERIES = {f.__name__: f for f in (
    page_issue_rows, heading_jumps, issue_code_counts, found_issue_counts, duplicate_titles, duplicate_descriptions, links_exploded, link_counts, broken_links, external_broken, redirected, orphan_pages, platforms, platform_rules, exact_duplicates, duplicate_content, simhashes,
    near_hash_pairs, near_duplicate_pages, near_duplicate_rule, issue_group_urls, shared_title_urls, scan_pages, page_total, opportunity_rows, shingle_counts, readability, url_quality, normal_urls, vitals, vitals_issues, metric_defaults, opportunities, severity_pivot, scan_scores, top_deductions, issue_groups, first_issues, issues_with_pages,
    issue_filter, page_search, page_list, recent_scans, scan_summary, export_issues, root_pages, nested_scans, pages_with_metrics, recommendations, recommendation_texts, executive_summaries, action_plan, weighted_mean, crawl_levels,
)}
