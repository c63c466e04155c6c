"""Recommendations from grouped issues by a table of templates.

The templates are rows; issues meet them by an equi-join on the code, so a new
recommendation is a new row. Wordings are this library's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import url_host
from sitelens.operators.scores import severity_rank

#: For each code the family, phase in days, impact and effort.
FAMILIES = [
    ("BROKEN_INTERNAL_LINK", "links", 30, "high", "quick_win"),
    ("PAGE_NOT_FOUND_4XX", "links", 30, "high", "quick_win"),
    ("MISSING_TITLE", "titles", 30, "high", "quick_win"),
    ("DUPLICATE_TITLE", "titles", 30, "high", "quick_win"),
    ("MISSING_META_DESCRIPTION", "descriptions", 30, "medium", "quick_win"),
    ("MISSING_STRUCTURED_DATA", "structured_data", 60, "high", "moderate"),
    ("MISSING_PRODUCT_SCHEMA", "structured_data", 60, "high", "moderate"),
    ("SHOPIFY_COLLECTION_PRODUCT_DUPLICATE", "product_urls", 30, "high", "quick_win"),
    ("POOR_LCP", "loading", 60, "high", "moderate"),
    ("NEEDS_WORK_LCP", "loading", 60, "high", "moderate"),
]
ADVICE = {
    "links": "Point the links at pages that answer, or redirect the old addresses.",
    "titles": "Give every page a title of its own of at most 60 characters.",
    "descriptions": "Describe every page in 120 to 158 characters.",
    "structured_data": "Describe the page's subject in JSON-LD and validate it.",
    "product_urls": "Link to products by their own URL and not by a collection's.",
    "loading": "Load the main image first and scripts later.",
    "other": "Review the pages listed and scan again.",
}
#: What stands behind each family's advice: the problem ({n} pages or links, {title} the issue's title), why it matters, what comes of it.
REASONS = {
    "links": ("{n} links or pages lead to an error.", "Visitors and crawlers end at pages that are not there, and what links pass on is lost.", "Crawlers reach every page that is linked."),
    "titles": ("{n} pages have no title of their own.", "The title is the first thing a search result shows, and pages of one title compete with each other.", "Results name what each page is about."),
    "descriptions": ("{n} pages have no description.", "Search engines then show some passage of the text.", "Results show a text that was written for them."),
    "structured_data": ("{n} pages have no structured data.", "Prices, ratings and paths are shown in results only where they are marked up.", "Pages can be shown as rich results."),
    "product_urls": ("{n} products are reached below collections.", "One product at many addresses divides what speaks for it.", "Each product is found at one address."),
    "loading": ("The main content of {n} pages appears late.", "Slow pages are left, and speed counts in the ranking.", "Pages pass the limits of good vitals."),
    "other": ("{n} cases of: {title}", "Each weakens how the site is found and used.", "The site keeps to common practice."),
}
#: Steps of each family; a platform's own go before the general ones (None).
STEPS = {
    ("links", None): ["List the addresses that fail.", "Choose for each the page that took its place.", "Redirect it for good, and mend the links in menus and texts."],
    ("titles", "shopify"): ["Open the product or page in the shop's administration.", "Edit its search engine listing.", "Enter a title of its own of 50 to 60 characters."],
    ("titles", "wordpress"): ["Open the post or page in the editor.", "Open the panel of the SEO plug-in.", "Enter a title of its own."],
    ("titles", None): ["Open the template of the page.", "Put a title element of its own into the head."],
    ("descriptions", "shopify"): ["Edit the search engine listing of the product or page.", "Describe it in 140 to 155 characters."],
    ("descriptions", None): ["Put a meta element named description into the head of each page.", "Describe what the visitor finds there."],
    ("structured_data", None): ["Choose the type that fits the page: organisation, product, article.", "Put its JSON-LD into the head.", "Test it with a validator."],
    ("product_urls", None): ["Find where the theme builds links to products.", "Leave out the collection, and name the product's own URL as canonical."],
    ("loading", None): ["Preload the main image.", "Load scripts and styles that are not needed at once later.", "Serve pictures in the size they are shown in."],
    ("other", None): ["Look at the pages listed.", "Mend what the issue names, and scan again."],
}
#: An example for each family: language, file, code.
SNIPPETS = {
    "links": ("apache", ".htaccess", "Redirect 301 /old /new"), "titles": ("html", None, "<title>What the page is about - Name</title>"), "descriptions": ("html", None, '<meta name="description" content="What is found here">'),
    "structured_data": ("json", None, '{"@context": "https://schema.org", "@type": "Organization", "name": "Name"}'), "product_urls": ("liquid", "product-card.liquid", "{{ product.url }}"), "loading": ("html", None, '<link rel="preload" as="image" href="/main.webp">'),
}
MOST, MOST_PER_PHASE, SAMPLES = 10, 6, 3


def recommendations(issues: DataFrame, most: int = MOST, platforms: DataFrame | None = None, urls: DataFrame | None = None) -> DataFrame:
    """The recommendations of each scan: quick wins of high impact first, then by severity and number.

    (scan_id, rank, code, family, phase, priority, impact, effort, affected, advice, platform, problem, why_it_matters,
    how_to_fix, code_snippet, estimated_result, sample_pages). ``platforms`` (scan_id, platform) chooses the steps,
    'custom' without it; ``urls`` (page_id, url) gives the pages of the first three issues of each code. Texts come from tables
    that are joined or looked up, so a new family is a new row.
    """
    spark = issues.sparkSession
    table = spark.createDataFrame(FAMILIES, "code string, family string, phase int, t_impact string, effort string")
    title = F.min_by("title", "issue_id") if "title" in issues.columns else F.lit(None).cast("string")
    by = issues.groupBy("scan_id", "code").agg(F.count("*").alias("affected"), F.min_by("severity", "issue_id").alias("severity"), title.alias("title"))
    if platforms is None:
        by = by.withColumn("platform", F.lit("custom"))
    else:
        by = by.join(platforms.select("scan_id", "platform"), "scan_id", "left").withColumn("platform", F.coalesce("platform", F.lit("custom")))
    priority = F.when(F.col("severity").isin("critical", "high"), "high").otherwise("medium")
    rows = by.join(F.broadcast(table), "code", "left").select(
        "scan_id", "code", "severity", "affected", "title", "platform", priority.alias("priority"), F.coalesce("family", F.lit("other")).alias("family"), F.coalesce("phase", F.lit(90)).alias("phase"),
        F.coalesce("t_impact", priority).alias("impact"), F.coalesce("effort", F.lit("moderate")).alias("effort"),
    )
    quick = (F.col("effort") == "quick_win") & (F.col("impact") == "high")
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(quick.desc(), severity_rank(F.col("severity")), F.desc("affected"), "code"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    if urls is None:
        first = first.withColumn("sample_pages", F.array().cast("array<string>"))
    else:
        at = F.row_number().over(Window.partitionBy("scan_id", "code").orderBy("issue_id"))
        with_page = issues.where("page_id is not null").join(urls.select("page_id", "url"), "page_id").where("url is not null")
        shown = with_page.withColumn("__r", at).where(F.col("__r") <= SAMPLES).groupBy("scan_id", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "url"))), lambda x: x["url"]).alias("sample_pages"))
        first = first.join(shown, ["scan_id", "code"], "left").withColumn("sample_pages", F.coalesce("sample_pages", F.array().cast("array<string>")))
    family = F.col("family")
    look = lambda entries: F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    reason = lambda n: look({k: F.lit(v[n]) for k, v in REASONS.items()})[family]
    steps = look({f"{k}/{on or ''}": F.array(*map(F.lit, v)) for (k, on), v in STEPS.items()})
    wp = F.when(F.col("platform") == "woocommerce", "wordpress").otherwise(F.col("platform"))
    snippet = look({k: F.struct(F.lit(a).alias("language"), F.lit(b).cast("string").alias("filename"), F.lit(c).alias("code")) for k, (a, b, c) in SNIPPETS.items()})[family]
    problem = F.replace(F.replace(reason(0), F.lit("{n}"), F.col("affected").cast("string")), F.lit("{title}"), F.coalesce("title", "code"))
    return first.select(
        "scan_id", "rank", "code", "family", "phase", "priority", "impact", "effort", "affected", look({k: F.lit(v) for k, v in ADVICE.items()})[family].alias("advice"), "platform", problem.alias("problem"), reason(1).alias("why_it_matters"),
        F.coalesce(steps[F.concat(family, F.lit("/"), wp)], steps[F.concat(family, F.lit("/"))]).alias("how_to_fix"), snippet.alias("code_snippet"), reason(2).alias("estimated_result"), "sample_pages",
    )


def plan(recommended: DataFrame, most: int = MOST_PER_PHASE) -> DataFrame:
    """(scan_id, phase, advice): the distinct advice of each phase, the first ``most``, in order of rank."""
    distinct = recommended.groupBy("scan_id", "phase", "advice").agg(F.min("rank").alias("rank"))
    ranked = F.row_number().over(Window.partitionBy("scan_id", "phase").orderBy("rank"))
    return distinct.withColumn("__r", ranked).where(F.col("__r") <= most).select("scan_id", "phase", "advice", "rank")


def summary(scored: DataFrame, groups: DataFrame, roots: DataFrame | None = None, platforms: DataFrame | None = None) -> DataFrame:
    """(scan_id, summary): the score, the grade and the numbers of critical and high codes; the site's name and platform where ``roots`` (scan_id, root_url) and ``platforms`` are given."""
    counts = groups.groupBy("scan_id").agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "high").alias("h"))
    zero, out = F.lit(0), scored.join(counts, "scan_id", "left")
    text = F.format_string("Score %d of 100, grade %s; %d critical and %d high kinds of issue.", "overall", "grade", F.coalesce("c", zero), F.coalesce("h", zero))
    if roots is not None:
        out = out.join(roots.select("scan_id", F.coalesce(url_host(F.col("root_url")), F.lit("website")).alias("__site")), "scan_id", "left")
        text = F.concat(F.coalesce("__site", F.lit("website")), F.lit(": "), text)
    if platforms is not None:
        out = out.join(platforms.select("scan_id", "platform"), "scan_id", "left")
        text = F.concat(text, F.lit(" Platform: "), F.coalesce("platform", F.lit("custom")), F.lit("."))
    return out.select("scan_id", text.alias("summary"))


def public_report(scored: DataFrame, recommended: DataFrame, mode: str = "executive") -> DataFrame:
    """The recommendations as a public report shows them: problem and result in the mode 'executive', steps and snippet as well in 'technical'."""
    if mode not in ("executive", "technical"):
        raise ValueError("mode is executive or technical")
    names = ["rank", "code", "problem", "why_it_matters", "estimated_result", *(["how_to_fix", "code_snippet", "sample_pages"] if mode == "technical" else [])]
    return scored.select("scan_id", "overall", "grade").join(recommended.select("scan_id", *names), "scan_id", "left")
