import pytest

from sitelens.operators import search
from sitelens.sources import requests as R


def test_requests_are_completed_and_bounded():
    assert R.scan_request("example.com/a") == R.ScanRequest("https://example.com/a", 25, 3)
    assert R.scan_request(" http://example.com ", 500, 0) == R.ScanRequest("http://example.com", 100, 1)
    for bad in (None, "", "ftp://x", "https://"):
        with pytest.raises(ValueError):
            R.scan_request(bad)


def test_measured_vitals_go_first(spark, make_pages):
    m = spark.createDataFrame([(2, 40, 5.0, 2.0, 0.3, 700, 200)], "page_id bigint, perf_score int, lcp double, fcp double, cls double, tbt int, inp int")
    got = {r.page_id: (r.source, r.perf_score) for r in R.vitals(make_pages({}, {}), m).collect()}
    assert got[1][0] == "estimated" and got[2] == ("measured", 40)


def test_sites_and_demo(spark):
    df = spark.createDataFrame([('{"siteEntry": [{"siteUrl": "https://a", "permissionLevel": "owner"}]}',), ("broken",), (None,)], "value string")
    assert [tuple(r) for r in R.search_sites(df).collect()] == [("https://a", "owner")]
    assert R.demo_pages(spark).count() == 5 and search.totals(R.demo_search_rows(spark)).first().clicks == 15.0
