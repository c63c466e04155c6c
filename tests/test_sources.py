import json

from pyspark.sql import functions as F

from sitelens.operators.extract import extract, read_page
from sitelens.operators.crawl import blocked_pages, crawl_order
from sitelens.operators.rules import page_issues
from sitelens.sources import files, sinks

HTML = """<!doctype html><html><head><TITLE> A &amp; B </TITLE><meta NAME="Description" content=" Text "><meta name=robots content="NoIndex"><link rel=canonical href="/c/../d">
<script type="application/ld+json">{"@graph": [{"@type": "Product"}, {"@type": ["A", "B"]}]}</script><script>var x = "</p>";</script><style>p {}</style></head>
<body><h1>One</h1><h3>Two <b>bold</h3><h1> </h1><p>Some text<ul><li>a</li><li>b</li></ul><!-- no --><noscript>hidden</noscript>
<img src="/i.png" alt=" " width="12px"><img data-src=x.png><img alt=none><a href="p#q"> go </a><a href="#t">t</a><a href="mailto:a@b">m</a><a href="https://other.com/x" aria-label="lab"></a><img src="http://plain.com/i.png" alt="i">"""


def test_every_field_of_a_page():
    page = read_page(HTML, "https://Example.com/a/")
    assert page["title"] == "A & B" and page["meta_description"] == "Text" and page["meta_robots"] == "noindex" and page["canonical_url"] == "https://example.com/d"
    assert page["h1_list"] == ["One"] and [(h["level"], h["text"]) for h in page["headings"]] == [(1, "One"), (3, "Two bold")]
    assert "ab" in page["body_text"] and "hidden" not in page["body_text"] and "var x" not in page["body_text"]
    assert [(i["src"], i["alt"], i["width"]) for i in page["images"]] == [("/i.png", "", 12), ("x.png", None, None), ("http://plain.com/i.png", "i", None)]
    assert [(a["url"], a["anchor_text"]) for a in page["internal_links"]] == [("https://example.com/a/p", "go")]
    assert [(a["url"], a["anchor_text"]) for a in page["external_links"]] == [("https://other.com/x", "lab")]
    assert page["structured_data_types"] == ["Product", "A,B"] and page["mixed_content"] == ["http://plain.com/i.png"]
    assert read_page(HTML, "https://example.com/", compat=True)["has_structured_data"] is False


def test_extract_feeds_the_rules(spark):
    raw = spark.createDataFrame([("https://e.com/", HTML, 200, 0, "mine"), ("https://e.com/n", None, 500, 1, None)], "url string, html string, status_code int, depth int, title string")
    pages = extract(raw.withColumn("headers", F.create_map(F.lit("content-security-policy"), F.lit("x"), F.lit("x-robots-tag"), F.lit("None")))).cache()
    first, second = pages.orderBy("url").collect()
    assert first.title == "A & B" and first.robots_directives == "noindex, none" and first.security_headers.csp and not first.security_headers.hsts
    assert second.body_text == "" and second.word_count == 0 and second.title is None and second.flesch_score == 0
    ready = pages.select("*", F.lit("s").alias("scan_id"), F.monotonically_increasing_id().alias("page_id"), F.lit(0).alias("page_ord"), F.lit(None).cast("boolean").alias("ssl_valid"), F.lit(None).cast("int").alias("ssl_days_remaining"))
    assert "MISSING_TITLE" in {r.code for r in page_issues(ready).collect()}
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") <= 1


def test_robots(spark):
    text = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\nSitemap: https://e.com/map.xml\n"
    table = spark.createDataFrame([("e.com", text), ("f.com", None)], "host string, text string")
    rules = files.robots_rules(table, "ours")
    urls = spark.createDataFrame([("e.com", p) for p in ("/private/x", "/private/open/y", "/a.pdf", "/a.pdfx", "/z")] + [("g.com", "/private")], "host string, path string")
    got = {(r.host, r.path): r.disallowed for r in files.disallowed(urls, rules).collect()}
    assert got == {("e.com", "/private/x"): True, ("e.com", "/private/open/y"): False, ("e.com", "/a.pdf"): True, ("e.com", "/a.pdfx"): False, ("e.com", "/z"): False, ("g.com", "/private"): False}
    assert files.disallowed(urls, files.robots_rules(table, "BadBot")).where("disallowed and host = 'e.com'").count() == 5
    assert sorted(r.sitemap_url for r in files.sitemap_lines(table.where("host = 'e.com'")).collect()) == ["https://e.com/map.xml"]


def test_sitemaps_follow_indexes_once(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>m{i}</loc></sitemap>" for i in range(7)) + "<sitemap><loc>root</loc></sitemap></sitemapindex>"
    rows = [("root", index)] + [(f"m{i}", f"<urlset><url><loc> https://e.com/{i} </loc></url><url><loc>https://e.com/x</loc></url></urlset>") for i in range(7)] + [("bare", "<loc>https://e.com/p</loc><loc>https://e.com/q.xml</loc>")]
    table = spark.createDataFrame(rows, "sitemap_url string, xml string")
    roots = spark.createDataFrame([("root",), ("bare",)], "sitemap_url string")
    got = files.sitemap_urls(roots, table).orderBy("root", "ord").collect()
    assert [r.url for r in got if r.root == "root"] == ["https://e.com/0", "https://e.com/x", "https://e.com/1", "https://e.com/2", "https://e.com/3", "https://e.com/4"]
    assert [r.url for r in got if r.root == "bare"] == ["https://e.com/p"]
    assert files.sitemap_urls(roots, table, most=2).where("root = 'root'").count() == 2


def test_page_speed_and_search_reports(spark, tmp_path):
    audits = {"largest-contentful-paint": {"numericValue": 3456.0}, "cumulative-layout-shift": {"numericValue": 0.1234}, "unused-javascript": {"score": 0.5, "title": "Less code"}, "modern-image-formats": {"score": 0.95, "title": "x"}, "uses-text-compression": {"score": None, "title": "y"}}
    (tmp_path / "a.json").write_text(json.dumps({"id": "https://e.com", "lighthouseResult": {"categories": {"performance": {"score": 0.555}}, "audits": audits}}))
    row = files.page_speed(spark, str(tmp_path / "a.json")).first()
    assert (row.perf_score, row.lcp, row.cls, row.tbt) == (56, 3.46, 0.123, 0) and [o.title for o in row.opportunities] == ["Less code"]
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"keys": ["q"], "clicks": 1, "impressions": 3, "ctr": 0.33333, "position": 2.25}, {"keys": [], "clicks": 0, "impressions": 0, "ctr": 0, "position": 0}]}))
    from sitelens.operators import search

    rows = files.search_report(spark, str(tmp_path / "b.json"))
    assert [tuple(r) for r in search.shaped(rows).collect()] == [("q", 1.0, 3.0, 33.33, 2.3), (None, 0.0, 0.0, 0.0, 0.0)]
    assert search.totals(rows.where("impressions = 0")).first()[2:] == (0.0, 0.0)


def test_fetcher_errors_become_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("no")
        return {"html": "<title>x</title>", "headers": {"A": "b"}}

    got = {r.url: r for r in files.fetched(spark.createDataFrame([("https://e.com/",), ("https://bad.com/",)], "url string"), fetch).collect()}
    assert got["https://bad.com/"].status_code == 500 and got["https://e.com/"].headers == {"a": "b"}


def test_crawl_meets_pages_in_order_within_its_budget(spark):
    seeds = spark.createDataFrame([("s", "https://e.com/", 0, 0), ("s", "https://e.com/map", 1, 1)], "scan_id string, url string, depth int, seed_ord bigint")
    links = [("/", 0, "/b"), ("/", 1, "/a?utm_source=x"), ("/", 2, "/b#x"), ("/a", 0, "/c"), ("/b", 0, "/d"), ("/b", 1, "/"), ("/c", 0, "/e")]
    edges = spark.createDataFrame([("s", "https://e.com" + a, n, "https://e.com" + b) for a, n, b in links] + [("s", "https://e.com/", 3, "https://o.com/")], "scan_id string, from_url string, link_ord int, target_url string")
    got = [(r.url.removeprefix("https://e.com"), r.depth) for r in crawl_order(seeds, edges, 2, 25).orderBy("ord").collect()]
    assert got == [("/", 0), ("/map", 1), ("/b", 1), ("/a", 1), ("/d", 2), ("/c", 2)]
    assert crawl_order(seeds, edges, 2, 3).count() == 3 and crawl_order(seeds.limit(0), edges).count() == 0
    row = blocked_pages(seeds.withColumn("depth", F.lit(0))).first()
    assert row.status_code == 403 and row.security_headers is None


def fifo_crawl(seeds, links, most_depth, most):
    """The crawl as one queue: what the level-by-level plan must equal."""
    queue, seen, met = [], set(), []
    for url, depth in seeds:
        if url not in seen:
            seen.add(url)
            queue.append((url, depth))
    while queue and len(met) < most:
        queue.sort(key=lambda x: x[1])  # seeds of the next level wait for their level
        url, depth = queue.pop(0)
        met.append((url, depth))
        if depth < most_depth and len(met) + len(queue) < 2 * most:
            for target in links.get(url, []):
                if target not in seen:
                    seen.add(target)
                    queue.append((target, depth + 1))
    return met


def test_crawl_equals_a_queue_on_random_sites(spark):
    import random

    rng = random.Random(5)
    sites, seeds, edges, bounds = {}, [], [], []
    for s in range(8):
        urls = [f"https://s{s}.example/p{k}" for k in range(60)]
        links = {u: [rng.choice(urls) for _ in range(rng.randint(0, 9))] for u in urls}
        own = [(urls[0], 0), (urls[7], 1)]
        sites[f"s{s}"] = (own, links, rng.randint(1, 5), rng.choice([4, 9, 30]))
        seeds += [(f"s{s}", u, d, k) for k, (u, d) in enumerate(own)]
        edges += [(f"s{s}", u, n, t) for u, ts in links.items() for n, t in enumerate(ts)]
        bounds.append((f"s{s}", sites[f"s{s}"][2], sites[f"s{s}"][3]))
    b = spark.createDataFrame(bounds, "scan_id string, max_depth int, max_pages int")
    got = crawl_order(spark.createDataFrame(seeds, "scan_id string, url string, depth int, seed_ord bigint"), spark.createDataFrame(edges, "scan_id string, from_url string, link_ord int, target_url string"), bounds=b).collect()
    for name, (own, links, deep, most) in sites.items():
        rows = sorted((r.ord, r.url, r.depth) for r in got if r.scan_id == name)
        assert [(u, d) for _, u, d in rows] == fifo_crawl(own, links, deep, most), name


def test_records_of_pages_that_could_not_be_read(spark):
    from sitelens.operators.crawl import failed_pages

    urls = spark.createDataFrame([("s", "https://e.com/x", 2)], "scan_id string, url string, depth int")
    row = failed_pages(urls).first()
    assert (row.status_code, row.body_text, row.h1_list, row.security_headers, row.depth) == (500, "", [], None, 2)
    assert blocked_pages(urls).first().robots_directives == "Disallowed in robots.txt"


def test_states_of_a_scan(spark):
    notes = []
    done = []
    assert sinks.run_states(spark, "s", {"crawling": lambda: done.append(1)}, notes.append) == "complete" and done == [1]
    all_notes = notes[0]
    for n in notes[1:]:
        all_notes = all_notes.unionByName(n)
    assert sinks.latest_status(all_notes).first().status == "complete" and all_notes.count() == 6
    notes.clear()
    assert sinks.run_states(spark, "s", {"scoring": lambda: 1 / 0}, notes.append) == "failed"
    assert [n.first().status for n in notes] == ["queued", "crawling", "analyzing", "scoring", "failed"] and "division" in notes[-1].first().error_text
    assert not sinks.follows("complete", "failed") and not sinks.follows("queued", "scoring") and sinks.follows(None, "queued")


def test_report_sections_are_ordered_and_counted(spark):
    issues = spark.createDataFrame([("low", f"t{i:02}", "u") for i in range(50)] + [("critical", "worst", "u"), (None, None, None)], "severity string, title string, url string").repartition(5)
    recs = spark.createDataFrame([(1, "p <1>", ["do this"], "better")], "rank int, problem string, how_to_fix array<string>, estimated_result string")
    html = sinks.report("T", 50, "C", None, issues, 5, {"technical": 40}, recs, summary="In short")
    assert "low: 50" in html and html.index("worst") < html.index("t00") and "t05" not in html and "p &lt;1&gt;" in html and "do this" in html and "In short" in html
    assert html == sinks.report("T", 50, "C", None, issues.repartition(2), 5, {"technical": 40}, recs, summary="In short")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "high", "<b>", "https://e.com/?a=<script>", ["x"])], "scan_id string, severity string, title string, url string, l array<string>")
    sinks.append(df, str(tmp_path / "t"))
    sinks.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    html = sinks.report("R <x>", 90, "A", {"high": 1}, df)
    assert "<script>" not in html and "&lt;script&gt;" in html and "R &lt;x&gt;" in html
    sinks.export_sheets(str(tmp_path / "x"), df, df, df, df)
    assert spark.read.option("header", True).csv(str(tmp_path / "x/action_plan")).first().l == '["x"]'
    states = spark.createDataFrame([("s", "queued", 1), ("s", "complete", 2)], "scan_id string, status string, at int")
    assert sinks.latest_status(states).first().status == "complete"
    assert json.loads(sinks.as_json(df).first().value)["severity"] == "high"


def test_stream_audits_each_file_once(spark, make_pages, tmp_path):
    from sitelens.streaming.incremental import audit_stream, severity_windows

    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make_pages({"title": ""}).write.parquet(src)
    audit_stream(spark, src, out, state).awaitTermination()
    make_pages({"status_code": 500}).write.mode("append").parquet(src)
    audit_stream(spark, src, out, state).awaitTermination()
    assert sorted(r.code for r in spark.read.parquet(out).collect()) == ["MISSING_TITLE", "SERVER_ERROR_5XX"]
    stamped = spark.read.parquet(out).withColumn("fetched_at", F.lit("2025-01-01 10:30:00").cast("timestamp"))
    assert severity_windows(stamped).count() == 2
