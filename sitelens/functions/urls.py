"""URL functions: parsing and serialising as browsers do, as far as http(s) needs it."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_plus, urljoin, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query fields that track visitors.
TRACKING = frozenset(["utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid"])
_PARTS = re.compile(r"^([a-z][a-z0-9+.\-]*):(?://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?(#.*)?$", re.IGNORECASE | re.DOTALL)
_PORTS = {"http": "80", "https": "443"}


def parse(url: str | None) -> tuple[str, str, str, str, str, str] | None:
    """(scheme, host, port, path, query with ?, fragment with #) of an absolute http(s) URL, else None."""
    match = _PARTS.match((url or "").strip())
    if not match or match[1].lower() not in _PORTS or not match[2] or re.search(r"[\s<>^|%\\]", match[2]):
        return None
    scheme, host = match[1].lower(), match[2].lower()
    try:
        host = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        return None
    port = match[3] if match[3] and match[3] != _PORTS[scheme] else ""
    out: list[str] = []
    parts = match[4].replace("\\", "/").split("/")[1:] if match[4] else [""]
    for i, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        if low == "..":
            out = out[:-1]
        if low in (".", ".."):
            out += [""] if i == len(parts) - 1 else []
        else:
            out.append(part)
    path = "/" + quote("/".join(out), safe="/%!$&'()*+,;=:@~-._[]|^")
    query = quote(match[5] or "", safe="?/%!$&()*+,;=:@~-._[]|^`{}\\")
    return scheme, host, port, path, query, match[6] or ""


def _text(scheme: str, host: str, port: str, path: str, query: str, fragment: str) -> str:
    return f"{scheme}://{host}{':' + port if port else ''}{path}{query if query != '?' else ''}{fragment if fragment != '#' else ''}"


def normalized(url: str | None) -> str | None:
    """Without fragment, tracking fields and one final slash; text that is no URL comes back as it is."""
    if (parts := parse(url)) is None:
        return url
    scheme, host, port, path, query, _ = parts
    if query:
        fields = [(unquote_plus(k), unquote_plus(v)) for k, _, v in (f.partition("=") for f in query[1:].split("&") if f)]
        kept = [(k, v) for k, v in fields if k not in TRACKING]
        if len(kept) < len(fields):
            query = "?" + urlencode(kept, safe="*-._") if kept else ""
    if path.endswith("/") and len(path) > 1:
        path = path[:-1]
    return _text(scheme, host, port, path, query, "")


def resolved(url: str | None, base: str | None) -> str | None:
    """The absolute form of ``url`` seen from ``base`` without its fragment, None if there is none."""
    if url is None:
        return None
    try:
        parts = parse(urljoin(base or "", url.strip()))
    except ValueError:
        return None
    return None if parts is None else _text(*parts[:5], "")


@F.pandas_udf(T.StringType())
def _normalized(urls: pd.Series) -> pd.Series:
    return urls.map(normalized, na_action="ignore")


@F.pandas_udf(T.StringType())
def _resolved(urls: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([resolved(u, b) for u, b in zip(urls, bases)], dtype=object)


def normal_url(c: Column) -> Column:
    return _normalized(c)


def resolve_url(c: Column, base: Column) -> Column:
    return _resolved(c, base)


def url_host(c: Column) -> Column:
    """Lower-case host of an http(s) URL, null for anything else."""
    found = F.lower(F.regexp_extract(F.trim(c), r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def url_path(c: Column) -> Column:
    """Path of an http(s) URL, / if empty, null for anything else."""
    found = F.regexp_extract(F.trim(c), r"(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.when(url_host(c).isNotNull(), F.when(found == "", "/").otherwise(found))


def query_fields(c: Column) -> Column:
    """Number of fields in the query, repeats counted."""
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    return F.size(F.filter(F.split(query, "&"), lambda f: f != ""))
