import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import local_session

    return local_session(4, "tests", 4)


PAGE_DDL = (
    "scan_id string, page_id bigint, page_ord int, url string, final_url string, status_code int, response_time_ms int, title string, meta_description string, h1_list array<string>, "
    "headings array<struct<level:int,text:string>>, canonical_url string, robots_directives string, word_count int, body_text string, images array<struct<src:string,alt:string,width:int,height:int>>, "
    "internal_links array<struct<url:string,anchor_text:string,status_code:int,hops:int>>, external_links array<struct<url:string,anchor_text:string,status_code:int>>, depth int, headers map<string,string>, "
    "has_structured_data boolean, structured_data_types array<string>, flesch_score int, ssl_valid boolean, ssl_days_remaining int, mixed_content array<string>, "
    "security_headers struct<hsts:boolean,csp:boolean,x_content_type_options:boolean,x_frame_options:boolean,referrer_policy:boolean>"
)
GOOD = {
    "scan_id": "s", "page_id": 1, "page_ord": 0, "url": "https://example.com/test", "final_url": "https://example.com/test", "status_code": 200, "response_time_ms": 150, "title": "A title of a fitting length for every test",
    "meta_description": "A description that is long enough to pass the lower bound and short enough for the upper one.", "h1_list": ["What this page is about"], "headings": [(1, "What this page is about")], "canonical_url": "https://example.com/test",
    "robots_directives": "index, follow", "word_count": 650, "body_text": "Sample body text", "images": [("/logo.png", "Company Logo", None, None)], "internal_links": [("https://example.com/about", "About Us", None, None)], "external_links": [],
    "depth": 0, "headers": {}, "has_structured_data": True, "structured_data_types": ["Organization"], "flesch_score": 65, "ssl_valid": None, "ssl_days_remaining": None, "mixed_content": None, "security_headers": None,
}


@pytest.fixture(scope="session")
def make_pages(spark):
    """A table of pages from dicts of what differs from a faultless page."""

    def make(*changes):
        rows = [tuple((GOOD | {"page_id": i + 1, "page_ord": i} | c)[k] for k in GOOD) for i, c in enumerate(changes)]
        return spark.createDataFrame(rows, PAGE_DDL)

    return make
