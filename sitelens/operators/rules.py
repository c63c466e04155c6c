"""Rules over pages, evaluated in one pass.

A rule is a predicate column with a category, a severity, a message and a detail.
:func:`page_issues` puts all rules of a registry into one array of structs and
explodes it, so that the pages are read once whatever the number of rules.
Register own rules with :meth:`Registry.rule`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import is_blank, utf16_length, web_trim
from sitelens.functions.urls import query_fields, url_path


@dataclass(frozen=True)
class Rule:
    code: str
    category: str
    severity: str
    title: str
    test: Callable[[], Column]
    detail: Callable[[], dict[str, Column]] = dict
    message: Callable[[], Column] | None = None


@dataclass
class Registry:
    rules: list[Rule] = field(default_factory=list)

    def rule(self, code: str, category: str, severity: str, title: str, detail: Callable[[], dict[str, Column]] = dict, message: Callable[[], Column] | None = None) -> Callable:
        """Decorator: the function returns the predicate column of one page. Without a ``message`` the issue's message is its title."""

        def add(test: Callable[[], Column]) -> Callable[[], Column]:
            self.rules.append(Rule(code, category, severity, title, test, detail, message))
            return test

        return add


PAGE = Registry()
_c = F.col
#: Titles and link texts that say nothing.
WEAK_TITLES = ["home", "untitled", "index", "welcome", "page 1", "default", "landing"]
WEAK_ANCHORS = ["click here", "read more", "learn more", "here", "link", "view more", "more", "this page"]


def _no_alt() -> Column:
    return F.filter("images", lambda i: is_blank(i["alt"]))


def _weak_links() -> Column:
    return F.filter("internal_links", lambda a: F.lower(web_trim(a["anchor_text"])).isin(WEAK_ANCHORS))


def heading_jump() -> Column:
    """The first heading more than one level below the deepest so far, as (deepest, level, text); null if there is none."""
    start = F.struct(F.lit(0).alias("deepest"), F.lit(None).cast("struct<jumpedFrom:int,jumpedTo:int,text:string>").alias("jump"))
    step = lambda acc, h: F.struct(
        F.greatest(acc["deepest"], h["level"]).alias("deepest"),
        F.coalesce(acc["jump"], F.when((acc["deepest"] > 0) & (h["level"] > acc["deepest"] + 1), F.struct(acc["deepest"].alias("jumpedFrom"), h["level"].alias("jumpedTo"), h["text"].alias("text")))).alias("jump"),
    )
    return F.aggregate(F.filter("headings", lambda h: h["level"].isNotNull()), start, step, lambda acc: acc["jump"])


def _n(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def _len(c: str) -> Column:
    return utf16_length(_c(c))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def said(text: str, **values: Column) -> Column:
    """``text`` with {name} replaced by the value of that name; a null value is left out."""
    parts = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", text)):
        parts.append(F.coalesce(values[piece].cast("string"), F.lit("")) if k % 2 else F.lit(piece))
    return F.concat(*parts)


def messages() -> dict[str, Callable[[], Column]]:
    """For each rule a sentence about the page at hand."""
    c, n = F.col, F.size
    fixed = {
        "MISSING_TITLE": "The page has no title, or a blank one.", "MISSING_META_DESCRIPTION": "The page has no meta description.", "MISSING_H1": "The page has no main heading (h1).", "MISSING_CANONICAL": "The page names no canonical URL.",
        "NO_INTERNAL_OUTBOUND_LINKS": "The page links to no other page of its site.", "MISSING_STRUCTURED_DATA": "The page has no structured data.", "INVALID_SSL_CERT": "The certificate of the host is not valid.",
        "MISSING_HSTS": "The answer lacks the Strict-Transport-Security header.", "MISSING_X_CONTENT_TYPE": "The answer lacks the X-Content-Type-Options header.", "MISSING_X_FRAME_OPTIONS": "The answer has neither an X-Frame-Options header nor a content security policy.",
        "A11Y_MISSING_H1": "Without a main heading screen readers find no start of the content.",
    }
    filled = {
        "TITLE_TOO_SHORT": lambda: said("The title has {n} characters; 30 to 60 are advised.", n=_len("title")), "TITLE_TOO_LONG": lambda: said("The title has {n} characters and is cut after about 60.", n=_len("title")),
        "META_DESC_TOO_SHORT": lambda: said("The meta description has {n} characters; 70 to 160 are advised.", n=_len("meta_description")), "META_DESC_TOO_LONG": lambda: said("The meta description has {n} characters and is cut after about 160.", n=_len("meta_description")),
        "MULTIPLE_H1": lambda: said("The page has {n} main headings.", n=n("h1_list")), "BROKEN_HEADING_HIERARCHY": lambda: said("A heading of level {b} follows one of level {a}.", a=heading_jump()["jumpedFrom"], b=heading_jump()["jumpedTo"]),
        "SERVER_ERROR_5XX": lambda: said("The server answered with status {s}.", s=c("status_code")), "PAGE_NOT_FOUND_4XX": lambda: said("The page answered with status {s}.", s=c("status_code")),
        "CANONICAL_MISMATCH": lambda: said("The canonical URL {u} has another path than the page.", u=c("canonical_url")), "INVALID_CANONICAL": lambda: said("The canonical URL {u} can not be read.", u=c("canonical_url")),
        "NOINDEX_DIRECTIVE": lambda: said("The directive {d} keeps the page from search results.", d=c("robots_directives")), "WEAK_GENERIC_TITLE": lambda: said("The title {t} says nothing about the page.", t=web_trim(c("title"))),
        "THIN_CONTENT": lambda: said("The page has {n} words; 300 are the least advised.", n=c("word_count")), "IMAGES_MISSING_ALT": lambda: said("{n} images have no alternative text.", n=n(_no_alt())), "NON_DESCRIPTIVE_ANCHOR": lambda: said("{n} links have texts that say nothing.", n=n(_weak_links())),
        "URL_TOO_LONG": lambda: said("The URL has {n} characters.", n=_len("url")), "URL_HAS_UPPERCASE": lambda: said("The path of {u} has capitals.", u=c("url")), "URL_HAS_UNDERSCORES": lambda: said("The path of {u} has underscores.", u=c("url")), "EXCESSIVE_URL_PARAMETERS": lambda: said("The URL has {n} fields.", n=query_fields(c("url"))),
        "POOR_READABILITY": lambda: said("The reading ease is {n}; 45 is the least advised.", n=c("flesch_score")), "NO_HTTPS": lambda: said("{u} is not encrypted.", u=c("url")), "SSL_EXPIRING_SOON": lambda: said("The certificate ends in {n} days.", n=c("ssl_days_remaining")),
        "MIXED_CONTENT": lambda: said("{n} parts of the page are loaded without encryption.", n=n("mixed_content")), "A11Y_IMAGES_MISSING_ALT": lambda: said("Screen readers can not name {n} images.", n=n(_no_alt())),
    }
    return {code: (lambda t=text: F.lit(t)) for code, text in fixed.items()} | filled


def _page_rules() -> None:
    add = PAGE.rule
    https = lambda: _sure(_c("url").startswith("https://"))
    ok = lambda: _sure(_c("status_code") == 200)
    path = lambda: url_path(_c("url"))
    secured = lambda: _c("security_headers").isNotNull()
    lacks = lambda name: ~_sure(_c("security_headers")[name])
    title = lambda: ~is_blank(_c("title"))
    meta = lambda: ~is_blank(_c("meta_description"))
    rows = [
        ("MISSING_TITLE", "technical", "high", "No title", lambda: is_blank(_c("title")), dict),
        ("TITLE_TOO_SHORT", "technical", "low", "Short title", lambda: title() & (_len("title") < 30), lambda: {"length": _len("title"), "title": _c("title")}),
        ("TITLE_TOO_LONG", "technical", "low", "Long title", lambda: title() & (_len("title") > 60), lambda: {"length": _len("title"), "title": _c("title")}),
        ("MISSING_META_DESCRIPTION", "technical", "medium", "No meta description", lambda: is_blank(_c("meta_description")), dict),
        ("META_DESC_TOO_SHORT", "technical", "low", "Short meta description", lambda: meta() & (_len("meta_description") < 70), lambda: {"length": _len("meta_description")}),
        ("META_DESC_TOO_LONG", "technical", "low", "Long meta description", lambda: meta() & (_len("meta_description") > 160), lambda: {"length": _len("meta_description")}),
        ("MISSING_H1", "technical", "high", "No main heading", lambda: _n("h1_list") == 0, dict),
        ("MULTIPLE_H1", "technical", "medium", "Several main headings", lambda: _n("h1_list") > 1, lambda: {"h1s": _c("h1_list")}),
        ("BROKEN_HEADING_HIERARCHY", "technical", "low", "Heading level skipped", lambda: heading_jump().isNotNull(), lambda: {k: heading_jump()[k] for k in ("jumpedFrom", "jumpedTo", "text")}),
        ("SERVER_ERROR_5XX", "technical", "critical", "Server error", lambda: _c("status_code") >= 500, dict),
        ("PAGE_NOT_FOUND_4XX", "technical", "critical", "Page not served", lambda: (_c("status_code") >= 400) & (_c("status_code") < 500), dict),
        ("MISSING_CANONICAL", "technical", "low", "No canonical URL", lambda: F.coalesce(_c("canonical_url"), F.lit("")) == "", dict),
        ("CANONICAL_MISMATCH", "technical", "medium", "Canonical URL of another path", lambda: (url_path(_c("canonical_url")) != path()) & ~_c("url").contains("?"), lambda: {"canonicalTarget": _c("canonical_url")}),
        ("INVALID_CANONICAL", "technical", "high", "Canonical URL unreadable", lambda: (F.coalesce(_c("canonical_url"), F.lit("")) != "") & (url_path(_c("canonical_url")).isNull() | path().isNull()), dict),
        ("NOINDEX_DIRECTIVE", "technical", "high", "Kept from the index", lambda: F.lower("robots_directives").contains("noindex"), lambda: {"directive": _c("robots_directives")}),
        ("WEAK_GENERIC_TITLE", "onpage", "medium", "Title says nothing", lambda: F.lower(web_trim(_c("title"))).isin(WEAK_TITLES), dict),
        ("THIN_CONTENT", "onpage", "medium", "Little text", lambda: ok() & (_c("word_count") < 300), lambda: {"wordCount": _c("word_count")}),
        ("IMAGES_MISSING_ALT", "onpage", "medium", "Images without alternative text", lambda: F.size(_no_alt()) > 0, lambda: {"count": F.size(_no_alt()), "sampleImages": F.slice(F.transform(_no_alt(), lambda i: i["src"]), 1, 5)}),
        ("NO_INTERNAL_OUTBOUND_LINKS", "onpage", "low", "No links within the site", lambda: ok() & (_n("internal_links") == 0), dict),
        ("NON_DESCRIPTIVE_ANCHOR", "onpage", "low", "Link texts say nothing", lambda: F.size(_weak_links()) > 0, lambda: {"count": F.size(_weak_links()), "sampleTargets": F.slice(F.transform(_weak_links(), lambda a: a["url"]), 1, 3)}),
        ("URL_TOO_LONG", "onpage", "low", "Long URL", lambda: _len("url") > 100, dict),
        ("URL_HAS_UPPERCASE", "onpage", "low", "Capitals in the URL", lambda: path().rlike("[A-Z]"), dict),
        ("URL_HAS_UNDERSCORES", "onpage", "low", "Underscores in the URL", lambda: path().contains("_"), dict),
        ("EXCESSIVE_URL_PARAMETERS", "onpage", "low", "Many URL fields", lambda: path().isNotNull() & (query_fields(_c("url")) > 3), dict),
        ("MISSING_STRUCTURED_DATA", "onpage", "low", "No structured data", lambda: ok() & ~_sure(_c("has_structured_data")) & (_c("depth") <= 1), dict),
        ("POOR_READABILITY", "onpage", "low", "Hard to read", lambda: (_c("word_count") > 150) & (_c("flesch_score") < 45), lambda: {"fleschScore": _c("flesch_score")}),
        ("NO_HTTPS", "security", "high", "Not encrypted", lambda: ~https(), dict),
        ("INVALID_SSL_CERT", "security", "critical", "Certificate not valid", lambda: ~_c("ssl_valid"), dict),
        ("SSL_EXPIRING_SOON", "security", "medium", "Certificate ends soon", lambda: _sure(F.coalesce(_c("ssl_valid"), F.lit(True)) & (_c("ssl_days_remaining") > 0) & (_c("ssl_days_remaining") < 15)), lambda: {"daysRemaining": _c("ssl_days_remaining")}),
        ("MIXED_CONTENT", "security", "medium", "Unencrypted parts", lambda: _n("mixed_content") > 0, lambda: {"count": F.size("mixed_content"), "sampleResources": F.slice("mixed_content", 1, 5)}),
        ("MISSING_HSTS", "security", "low", "No transport security header", lambda: secured() & https() & lacks("hsts"), dict),
        ("MISSING_X_CONTENT_TYPE", "security", "low", "No content type header", lambda: secured() & lacks("x_content_type_options"), dict),
        ("MISSING_X_FRAME_OPTIONS", "security", "low", "No framing header", lambda: secured() & lacks("x_frame_options") & lacks("csp"), dict),
        ("A11Y_IMAGES_MISSING_ALT", "accessibility", "medium", "Images closed to screen readers", lambda: F.size(_no_alt()) > 0, lambda: {"count": F.size(_no_alt())}),
        ("A11Y_MISSING_H1", "accessibility", "medium", "No heading to go to", lambda: ok() & (_n("h1_list") == 0), dict),
    ]
    for code, category, severity, name, test, detail in rows:
        add(code, category, severity, name, detail, messages().get(code))(test)


_page_rules()
ISSUE_DDL = "struct<issue_ord:int,category:string,code:string,severity:string,title:string,message:string,detail:string>"


def evaluated(rules: list[Rule]) -> Column:
    """The array of issues of one row; a predicate that is null does not hold."""
    each = []
    for i, rule in enumerate(rules):
        detail = rule.detail()
        text = F.to_json(F.struct(*[c.alias(k) for k, c in detail.items()])) if detail else F.lit(None).cast("string")
        issue = F.struct(F.lit(i).alias("issue_ord"), F.lit(rule.category).alias("category"), F.lit(rule.code).alias("code"), F.lit(rule.severity).alias("severity"), F.lit(rule.title).alias("title"), (rule.message() if rule.message else F.lit(rule.title)).alias("message"), text.alias("detail"))
        each.append(F.when(F.coalesce(rule.test(), F.lit(False)), issue))
    return F.array_compact(F.array(*each))


def page_issues(pages: DataFrame, registry: Registry = PAGE) -> DataFrame:
    """Rows (scan_id, page_id, page_ord, url, issue_ord, category, code, severity, title, message, detail).

    Missing optional columns must be present as nulls; a null array counts as
    empty; a page without issues gives no row; other columns are ignored.
    """
    found = pages.withColumn("__issues", evaluated(registry.rules)).where(F.size("__issues") > 0)
    return found.select("scan_id", "page_id", "page_ord", "url", F.explode("__issues").alias("__i")).select("scan_id", "page_id", "page_ord", "url", "__i.*")

