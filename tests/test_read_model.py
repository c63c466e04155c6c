from pyspark.sql import functions as F

from sitelens.operators import read_model, recommend
from sitelens.tables import latest


def issues(spark, rows):
    return spark.createDataFrame(rows, "issue_id string, scan_id string, page_id bigint, category string, code string, severity string, title string, message string")


ROWS = [("a", "s", 1, "technical", "L", "low", "t", "m1"), ("b", "s", 2, "technical", "C", "critical", "t", "m2"), ("c", "s", None, "onpage", "M", "medium", "t", "m3"), ("d", "s", 2, "technical", "C", "critical", "t", "m4"), ("e", "s", 9, None, "H", "high", None, None)]


def test_latest_takes_the_newest_row_and_settles_ties(spark):
    df = spark.createDataFrame([(1, "old", 1, {"k": "v"}), (1, "new", 2, {}), (2, "x", None, None), (2, "y", None, None), (None, "z", 3, None)], "k int, v string, ingested_at int, m map<string,string>")
    one = {r.k: r.v for r in latest(df, "k").collect()}
    assert one[1] == "new" and set(one) == {1, 2}
    assert {r.k: r.v for r in latest(df.repartition(7), "k").collect()} == one
    assert latest(df.limit(0), "k").count() == 0


def test_groups_are_ranked_by_severity_then_number(spark):
    urls = spark.createDataFrame([(1, "u1"), (2, "u2")], "page_id bigint, url string")
    got = read_model.issue_groups(issues(spark, ROWS), urls).orderBy("rank").collect()
    assert [(r.code, r.n, r.urls) for r in got] == [("C", 2, ["u2"]), ("H", 1, []), ("M", 1, []), ("L", 1, ["u1"])]


def test_lists_and_filters(spark, make_pages):
    df = issues(spark, ROWS)
    assert [r.code for r in read_model.issue_list(df).collect()] == ["C", "C", "H", "L", "M"]
    assert read_model.issue_list(df, "s", "technical", "all").count() == 3 and read_model.issue_list(df, "s", severity="high").count() == 1
    pages = make_pages({"title": "Garden"}, {"url": "https://e.com/GARDEN", "title": None, "status_code": 404}, {"title": "%"})
    assert read_model.page_search(pages, "garden").count() == 2 and read_model.page_search(pages, " ", "x").count() == 3
    assert read_model.page_search(pages, "garden", "404").count() == 1 and read_model.page_search(pages, "%").count() == 1
    assert [r.page_id for r in read_model.paged(pages, "page_id", page=2, size=2).collect()] == [3]
    assert read_model.paged(pages, "page_id", page=9, size=2).count() == 0


def test_counts_joins_and_defaults(spark, make_pages):
    pages = make_pages({}, {"url": "https://e.com/2"})
    df = issues(spark, ROWS)
    counted = {r.page_id: r.n for r in read_model.with_counts(pages.select("page_id"), "page_id", n=df).collect()}
    assert counted == {1: 1, 2: 2}
    assert read_model.issues_with_pages(df, pages).where("url is null").count() == 2
    scans = spark.createDataFrame([("s", "https://root"), ("t", "x")], "scan_id string, root_url string")
    rows = read_model.export_issues(df, pages, scans).orderBy("row").collect()
    assert [(r.row, r.code, r.url) for r in rows] == [(1, "L", "https://example.com/test"), (2, "C", "https://e.com/2"), (3, "M", "https://root"), (4, "H", "https://root")]
    assert [r.page_id for r in read_model.root_page(pages, scans).collect()] == [1]
    assert read_model.root_page(pages, scans.withColumn("root_url", F.lit("https://e.com/2"))).first().page_id == 2
    m = spark.createDataFrame([("m", 1, 0, 0.0, None, 0.0, None, 5)], "metric_id string, page_id bigint, perf_score int, lcp double, inp int, cls double, fcp double, tbt int")
    assert read_model.metric_view(m).first()[2:] == (0, 0.0, 120, 0.0, 1.2, 5) and read_model.metric_view(m, True).first()[2:] == (85, 2.1, 120, 0.04, 1.2, 5)
    assert read_model.metrics_of_scan(m, pages, "s").count() == 1 and read_model.with_metrics(pages, m).count() == 2
    named = spark.createDataFrame([("s", "https://e.com/2", "X"), ("s", "https://none", "Y")], "scan_id string, url string, code string").withColumn("page_id", F.lit(7))
    assert {r.code: r.page_id for r in read_model.issue_page_ids(named, pages).collect()} == {"X": 2, "Y": None}


def test_recommendations(spark):
    rows = [("a", "s", 1, "technical", "MISSING_META_DESCRIPTION", "medium", "t", "m"), ("b", "s", 1, "technical", "DUPLICATE_TITLE", "high", "t", "m"), ("c", "s", 1, "technical", "POOR_LCP", "high", "t", "m"), ("d", "s", 1, "x", "OWN", "low", "t", "m")]
    recs = recommend.recommendations(issues(spark, rows)).orderBy("rank").collect()
    assert [(r.code, r.phase, r.impact, r.effort) for r in recs] == [("DUPLICATE_TITLE", 30, "high", "quick_win"), ("POOR_LCP", 60, "high", "moderate"), ("MISSING_META_DESCRIPTION", 30, "medium", "quick_win"), ("OWN", 90, "medium", "moderate")]
    many = [(f"{i:03}", "s", 1, "x", f"C{i}", "low", "t", "m") for i in range(30)]
    assert recommend.recommendations(issues(spark, many)).count() == 10
    assert recommend.plan(recommend.recommendations(issues(spark, rows))).count() == 4
    scored = spark.createDataFrame([("s", 80, "B")], "scan_id string, overall int, grade string")
    assert recommend.summary(scored, issues(spark, rows)).first().summary.startswith("Score 80 of 100, grade B; 0 critical and 2 high")


def test_lists_are_bounded_and_counts_are_not(spark):
    from sitelens.tables import first_listed

    df = spark.createDataFrame([("g", i, f"v{i}") for i in range(50)] + [(None, 1, None)], "g string, o int, v string").repartition(7)
    got = {r.g: r.l for r in first_listed(df, ["g"], ["o"], "v", "l", 5).collect()}
    assert got == {"g": ["v0", "v1", "v2", "v3", "v4"], None: [None]}
    rows = [(f"{i:04}", "s", i, "x", "C", "low", "t", "m") for i in range(1100)]
    urls = spark.createDataFrame([(i, f"u{i:04}") for i in range(1100)], "page_id bigint, url string")
    row = read_model.issue_groups(issues(spark, rows), urls).first()
    assert row.n_urls == 1100 and len(row.urls) == 1000 and row.urls[0] == "u0000"
