"""Raw HTML to page records, one parse for each page.

``html.parser`` of the standard library reads the mark-up as events; a page's
fields are collected in one go and come back as one Arrow struct, so the
plan has a single Python stage. Scripts are read for JSON-LD before their text
is dropped; ``compat=True`` never sees JSON-LD, as the observed behaviour of
parsers that drop scripts first.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import reading_ease
from sitelens.functions.urls import parse, resolved

_SPACE = re.compile(r"\s+")
_HIDDEN = {"script", "style", "noscript", "svg", "iframe"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Link schemes that lead to no page.
_NO_PAGE = ("javascript:", "mailto:", "tel:")
_IMAGE = pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.int32()), ("height", pa.int32())])
_LINK = pa.struct([("url", pa.string()), ("anchor_text", pa.string()), ("status_code", pa.int32()), ("hops", pa.int32())])
_OUTER = pa.struct([("url", pa.string()), ("anchor_text", pa.string()), ("status_code", pa.int32())])
_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string())])
_FIELDS = [
    ("title", pa.string()), ("meta_description", pa.string()), ("meta_robots", pa.string()), ("canonical_url", pa.string()), ("h1_list", pa.list_(pa.string())), ("headings", pa.list_(_HEADING)), ("body_text", pa.string()), ("word_count", pa.int32()),
    ("images", pa.list_(_IMAGE)), ("internal_links", pa.list_(_LINK)), ("external_links", pa.list_(_OUTER)), ("has_structured_data", pa.bool_()), ("structured_data_types", pa.list_(pa.string())), ("mixed_content", pa.list_(pa.string())),
]
_DDL = (
    "title string, meta_description string, meta_robots string, canonical_url string, h1_list array<string>, headings array<struct<level:int,text:string>>, body_text string, word_count int, "
    "images array<struct<src:string,alt:string,width:int,height:int>>, internal_links array<struct<url:string,anchor_text:string,status_code:int,hops:int>>, external_links array<struct<url:string,anchor_text:string,status_code:int>>, "
    "has_structured_data boolean, structured_data_types array<string>, mixed_content array<string>"
)


class _Reader(HTMLParser):
    def __init__(self, url: str, compat: bool):
        super().__init__(convert_charrefs=True)
        self.url, self.compat = url, compat
        self.title: list[str] | None = None
        self.metas: list[tuple[str, str]] = []
        self.canonical: str | None = None
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.in_title = self.in_body = False
        self.heading: tuple[int, list[str]] | None = None
        self.headings: list[tuple[int, str]] = []
        self.anchor: tuple[str, str | None, list[str]] | None = None
        self.anchors: list[tuple[str, str]] = []
        self.images: list[dict] = []
        self.ld: list[str] | None = None
        self.blocks: list[str] = []
        self.structured = False
        self.loaded: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("script", "link", "img", "iframe") and (not self.compat or tag in ("link", "img")):
            self.loaded += [a[k] for k in ("src", "href") if a.get(k, "").startswith("http://")]
        if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json" and not self.compat:
            self.ld = []
        if tag in _HIDDEN:
            self.hidden.append(tag)
            return
        if self.hidden:
            return
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "body":
            self.in_body = True
        elif tag == "meta":
            self.metas.append(((a.get("name") or a.get("property") or "").strip().lower(), a.get("content", "").strip()))
        elif tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").lower().split():
            self.canonical = a.get("href", "").strip()
        elif tag in _HEADINGS:
            self._end_heading()
            self.heading = (int(tag[1]), [])
        elif tag == "img":
            src = (a.get("src") or a.get("data-src") or "").strip()
            if src:
                number = lambda k: int(m.group()) if (m := re.match(r"\s*\d+", a.get(k, ""))) and int(m.group()) and int(m.group()) < 2**31 else None
                self.images.append({"src": src, "alt": a["alt"].strip() if "alt" in a else None, "width": number("width"), "height": number("height")})
        elif tag == "a" and "href" in a:
            self._end_anchor()
            self.anchor = (a["href"].strip(), a.get("aria-label"), [])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            self.blocks.append("".join(self.ld))
            self.ld = None
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag == "title":
            self.in_title = False
        elif tag in _HEADINGS:
            self._end_heading()
        elif tag == "a":
            self._end_anchor()

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        if self.hidden:
            return
        if self.in_title:
            self.title.append(data)
            return
        self.text.append(data)
        if self.heading:
            self.heading[1].append(data)
        if self.anchor:
            self.anchor[2].append(data)

    def _end_heading(self):
        if self.heading and (text := "".join(self.heading[1]).strip()):
            self.headings.append((self.heading[0], text))
        self.heading = None

    def _end_anchor(self):
        if self.anchor:
            href, label, text = self.anchor
            self.anchors.append((href, "".join(text).strip() or (label or "").strip()))
        self.anchor = None

    def types(self) -> list[str]:
        """The types of all blocks that can be read; ``structured`` tells whether any could."""
        out = []
        for block in self.blocks:
            try:
                data = json.loads(block)
            except ValueError:
                continue
            self.structured = True
            for item in data if isinstance(data, list) else [data]:
                if isinstance(item, dict):
                    inner = [item] if item.get("@type") else item.get("@graph") or []
                    out += [",".join(map(str, t)) if isinstance(t := x.get("@type"), list) else str(t) for x in inner if isinstance(x, dict) and x.get("@type")]
        return out

    def record(self) -> dict:
        self._end_heading()
        self._end_anchor()
        meta = lambda name: next((c for n, c in self.metas if n == name and c), None)
        own = parse(self.url)
        inner, outer = [], []
        for href, text in self.anchors:
            if not href or href.startswith("#") or href.lower().startswith(_NO_PAGE):
                continue
            if (target := resolved(href, self.url)) is None:
                continue
            if own and parse(target)[1] == own[1]:
                inner.append({"url": target, "anchor_text": text, "status_code": None, "hops": None})
            else:
                outer.append({"url": target, "anchor_text": text, "status_code": None})
        body = _SPACE.sub(" ", "".join(self.text)).strip()
        types = self.types()
        mixed = self.loaded if own and own[0] == "https" else []
        return {
            "title": ("".join(self.title).strip() or None) if self.title is not None else None, "meta_description": meta("description") or meta("og:description"), "meta_robots": (meta("robots") or "").lower() or None,
            "canonical_url": (resolved(self.canonical, self.url) or self.canonical) if self.canonical else None, "h1_list": [t for n, t in self.headings if n == 1], "headings": [{"level": n, "text": t} for n, t in self.headings],
            "body_text": body, "word_count": len(body.split()), "images": self.images, "internal_links": inner, "external_links": outer, "has_structured_data": self.structured, "structured_data_types": types, "mixed_content": mixed or None,
        }


def read_page(html: str | None, url: str, compat: bool = False) -> dict:
    """The fields of one page; text that is no mark-up is body text, null is an empty page."""
    reader = _Reader(url or "", compat)
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader.record()


def extract(raw: DataFrame, compat: bool = False) -> DataFrame:
    """Page records from rows with url and html, other columns kept (status_code, headers, depth and the like).

    A column of ``raw`` whose name is one of the record's gives way to the record's.
    """
    names = [n for n, _ in _FIELDS]
    kept = [c for c in raw.columns if c not in names and c != "html"]

    @F.pandas_udf(f"struct<{_ddl_struct(_DDL)}>")
    def parsed(html, url):
        import pandas as pd

        return pd.DataFrame([read_page(h, u, compat) for h, u in zip(html, url)], columns=names)

    out = raw.withColumn("__page", parsed("html", "url")).select(*kept, "__page.*")
    headers = F.col("headers") if "headers" in raw.columns else F.lit(None).cast("map<string,string>")
    present = lambda name: F.coalesce(headers[name], F.lit("")) != ""
    robots = F.nullif(F.concat_ws(", ", F.col("meta_robots"), F.lower(headers["x-robots-tag"])), F.lit(""))
    secured = F.struct(*[present(h).alias(c) for c, h in SECURITY_HEADERS.items()])
    out = out.withColumn("robots_directives", robots).withColumn("security_headers", secured).withColumn("flesch_score", reading_ease(F.col("body_text")))
    return out.withColumn("content_type", F.coalesce(headers["content-type"], F.lit("text/html"))).withColumn("final_url", F.col("url")).withColumn("rendered", F.lit(False)).drop("meta_robots")


#: Columns of the security header struct and the headers they stand for.
SECURITY_HEADERS = {"hsts": "strict-transport-security", "csp": "content-security-policy", "x_content_type_options": "x-content-type-options", "x_frame_options": "x-frame-options", "referrer_policy": "referrer-policy"}


def _ddl_struct(ddl: str) -> str:
    """Top-level fields of a DDL list with colons, as a struct type wants them."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)
