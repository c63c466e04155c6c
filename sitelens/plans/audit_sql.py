"""DuckDB SQL for the audit queries, written on its own and not from the Spark plans."""

from __future__ import annotations

_W = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _last(table: str, key: str, name: str, extra: str = "*") -> str:
    return f"{name} AS (SELECT {extra} FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


_P = _last("crawled_pages", "page_id", "p")
_SP = _last("site_pages", "page_id", "sp")
_SC = _last("scans", "scan_id", "sc")
_DOC = _last("documents", "doc_id", "d")
_IS = _last("issues", "issue_id", "i", "issue_id, scan_id, page_id, lower(category) AS category, code, severity, title, message")
_TRIM = lambda c: f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
_PATH = lambda c: f"CASE WHEN regexp_matches({c}, '^(?i)https?://[^/?#]+') THEN CASE WHEN regexp_extract({c}, '(?i)^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({c}, '(?i)^https?://[^/?#]+([^?#]*)', 1) END END"
_FIELDS = lambda c: f"len(list_filter(string_split(regexp_extract({c}, '^[^?#]*[?]([^#]*)', 1), '&'), lambda f: f <> ''))"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_PENALTY = "CASE severity WHEN 'critical' THEN 15 WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 1 END"
_T, _M = _TRIM("title"), _TRIM("meta_description")
_NO_ALT = f"len(list_filter(images, lambda x: x.alt IS NULL OR {_TRIM('x.alt')} = ''))"
_WEAK = f"len(list_filter(internal_links, lambda x: lower({_TRIM('x.anchor_text')}) IN ('click here','read more','learn more','here','link','view more','more','this page')))"
_TESTS = [
    ("MISSING_TITLE", "technical", "high", f"title IS NULL OR {_T} = ''"),
    ("TITLE_TOO_SHORT", "technical", "low", f"{_T} <> '' AND length(title) < 30"),
    ("TITLE_TOO_LONG", "technical", "low", f"{_T} <> '' AND length(title) > 60"),
    ("MISSING_META_DESCRIPTION", "technical", "medium", f"meta_description IS NULL OR {_M} = ''"),
    ("META_DESC_TOO_SHORT", "technical", "low", f"{_M} <> '' AND length(meta_description) < 70"),
    ("META_DESC_TOO_LONG", "technical", "low", f"{_M} <> '' AND length(meta_description) > 160"),
    ("MISSING_H1", "technical", "high", "coalesce(len(h1_list), 0) = 0"),
    ("MULTIPLE_H1", "technical", "medium", "len(h1_list) > 1"),
    ("SERVER_ERROR_5XX", "technical", "critical", "status_code >= 500"),
    ("PAGE_NOT_FOUND_4XX", "technical", "critical", "status_code BETWEEN 400 AND 499"),
    ("MISSING_CANONICAL", "technical", "low", "coalesce(canonical_url, '') = ''"),
    ("CANONICAL_MISMATCH", "technical", "medium", f"({_PATH('trim(canonical_url)')}) <> ({_PATH('trim(url)')}) AND NOT contains(url, '?')"),
    ("INVALID_CANONICAL", "technical", "high", f"coalesce(canonical_url, '') <> '' AND (({_PATH('trim(canonical_url)')}) IS NULL OR ({_PATH('trim(url)')}) IS NULL)"),
    ("NOINDEX_DIRECTIVE", "technical", "high", "contains(lower(robots_directives), 'noindex')"),
    ("WEAK_GENERIC_TITLE", "onpage", "medium", f"lower({_T}) IN ('home','untitled','index','welcome','page 1','default','landing')"),
    ("THIN_CONTENT", "onpage", "medium", "status_code = 200 AND word_count < 300"),
    ("IMAGES_MISSING_ALT", "onpage", "medium", f"{_NO_ALT} > 0"),
    ("NO_INTERNAL_OUTBOUND_LINKS", "onpage", "low", "status_code = 200 AND coalesce(len(internal_links), 0) = 0"),
    ("NON_DESCRIPTIVE_ANCHOR", "onpage", "low", f"{_WEAK} > 0"),
    ("URL_TOO_LONG", "onpage", "low", "length(url) > 100"),
    ("URL_HAS_UPPERCASE", "onpage", "low", f"regexp_matches({_PATH('trim(url)')}, '[A-Z]')"),
    ("URL_HAS_UNDERSCORES", "onpage", "low", f"contains({_PATH('trim(url)')}, '_')"),
    ("EXCESSIVE_URL_PARAMETERS", "onpage", "low", f"({_PATH('trim(url)')}) IS NOT NULL AND {_FIELDS('url')} > 3"),
    ("MISSING_STRUCTURED_DATA", "onpage", "low", "status_code = 200 AND NOT coalesce(has_structured_data, false) AND depth <= 1"),
    ("POOR_READABILITY", "onpage", "low", "word_count > 150 AND flesch_score < 45"),
    ("NO_HTTPS", "security", "high", "NOT starts_with(url, 'https://')"),
    ("INVALID_SSL_CERT", "security", "critical", "NOT ssl_valid"),
    ("SSL_EXPIRING_SOON", "security", "medium", "coalesce(ssl_valid, true) AND ssl_days_remaining > 0 AND ssl_days_remaining < 15"),
    ("MIXED_CONTENT", "security", "medium", "len(mixed_content) > 0"),
    ("MISSING_HSTS", "security", "low", "security_headers IS NOT NULL AND starts_with(url, 'https://') AND NOT coalesce(security_headers.hsts, false)"),
    ("MISSING_X_CONTENT_TYPE", "security", "low", "security_headers IS NOT NULL AND NOT coalesce(security_headers.x_content_type_options, false)"),
    ("MISSING_X_FRAME_OPTIONS", "security", "low", "security_headers IS NOT NULL AND NOT coalesce(security_headers.x_frame_options, false) AND NOT coalesce(security_headers.csp, false)"),
    ("A11Y_IMAGES_MISSING_ALT", "accessibility", "medium", f"{_NO_ALT} > 0"),
    ("A11Y_MISSING_H1", "accessibility", "medium", "status_code = 200 AND coalesce(len(h1_list), 0) = 0"),
]
_JUMPS = """hh AS (SELECT page_id, unnest(headings) AS h, generate_subscripts(headings, 1) AS k FROM p),
hm AS (SELECT page_id, k, h.level AS level, max(h.level) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest FROM hh WHERE h.level IS NOT NULL),
jumps AS (SELECT page_id, deepest AS jumped_from, level AS jumped_to FROM hm WHERE deepest > 0 AND level > deepest + 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k) = 1)"""
_RULES = " UNION ALL ".join(f"SELECT scan_id, page_id, '{c}' AS code, '{g}' AS category, '{s}' AS severity FROM p WHERE {t}" for c, g, s, t in _TESTS) + " UNION ALL SELECT p.scan_id, page_id, 'BROKEN_HEADING_HIERARCHY', 'technical', 'low' FROM jumps JOIN p USING (page_id)"
_DUP = lambda f, least: f"(SELECT page_id, count(*) OVER (PARTITION BY scan_id, lower({_TRIM(f)})) AS n FROM p WHERE length({_TRIM(f)}) > {least})"
_LINKS = "links AS (SELECT scan_id, page_id, unnest(internal_links) AS l, generate_subscripts(internal_links, 1) - 1 AS link_ord FROM p)"
_STATUS = """status AS (SELECT scan_id, u, arg_max(status_code, o) AS target_status FROM (
  SELECT scan_id, url AS u, page_ord * 2 AS o, status_code FROM p UNION ALL SELECT scan_id, final_url, page_ord * 2 + 1, status_code FROM p) WHERE u IS NOT NULL GROUP BY ALL)"""
_BROKEN = "SELECT links.page_id, l.url AS target_url, target_status FROM links JOIN status ON links.scan_id = status.scan_id AND l.url = status.u WHERE target_status >= 400"
_EXT = "SELECT page_id, l.url AS target_url, l.status_code AS status FROM (SELECT page_id, unnest(external_links) AS l FROM p) WHERE l.status_code >= 400"
_REDIR = "SELECT page_id, l.url AS target_url, l.hops AS hops FROM links WHERE l.hops >= 2"
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'))"
_SHINGLES = f"""kept AS (SELECT doc_id, text, list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 2) AS w FROM d),
sh AS (SELECT doc_id, text, CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS s FROM kept)"""
_SIM = f"""{_SHINGLES},
one AS (SELECT doc_id, md5(unnest(s)) AS m FROM sh),
votes AS (SELECT doc_id, b, sum(CASE WHEN (('0x' || substr(m, 2 * (b // 8) + 1, 2))::INTEGER >> (b % 8)) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM one, range(64) AS r(b) GROUP BY ALL),
sim AS (SELECT d.doc_id, coalesce(s, repeat('0', 64)) AS simhash, length(text) AS chars FROM d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS s FROM votes GROUP BY doc_id) USING (doc_id))"""
_WITH = lambda *parts: "WITH " + ", ".join(parts) + " "
def _normal(c: str) -> str:
    """The normal form of the plain URLs in the tables: no fragment, no tracking fields, no final slash."""
    bare = f"regexp_replace({c}, '#.*$', '')"
    fields = f"list_filter(string_split(regexp_extract({bare}, '[?](.*)$', 1), '&'), lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_source|utm_medium|utm_campaign|fbclid|gclid)(=|$)'))"
    path = f"regexp_replace({bare}, '[?].*$', '')"
    slash = f"CASE WHEN regexp_matches({path}, '^https?://[^/]+$') THEN {path} || '/' WHEN regexp_matches({path}, '^https?://[^/]+/.+/$') THEN {path}[:-2] ELSE {path} END"
    host = f"lower(regexp_extract({c}, '^https?://[^/?#]+'))"
    return f"replace({slash}, regexp_extract({c}, '^https?://[^/?#]+'), {host}) || CASE WHEN len({fields}) > 0 THEN '?' || array_to_string({fields}, '&') ELSE '' END"


_PSIM = _SIM.replace("doc_id", "page_id").replace("text", "body_text").replace(" FROM d", " FROM p").replace("d.page_id", "p.page_id")
_MARK_LISTS = {
    "shopify": (4, ["cdn.shopify.com", "Shopify.theme", "myshopify.com"]), "wordpress": (4, ["/wp-content/", "/wp-includes/", "wp-json"]), "woocommerce": (5, ["woocommerce", "wc-api", "wc-cart"]), "webflow": (5, ["data-wf-page", "assets.website-files.com", "uploads-ssl.webflow.com"]),
    "wix": (5, ["parastorage.com", "wix.com", "wix-warmup-data"]), "squarespace": (5, ["squarespace.com", "static1.squarespace.com"]), "nextjs": (5, ["__NEXT_DATA__", "_next/static"]),
}
_POINTS = ", ".join(f"sum(CASE WHEN {' OR '.join(f"contains(raw, '{m}')" for m in ms)} THEN {n} ELSE 0 END" + (" + CASE WHEN contains(u, '/collections/') OR contains(u, '/products/') THEN 2 ELSE 0 END" if k == "shopify" else "") + f") AS {k}" for k, (n, ms) in _MARK_LISTS.items())
_HOLDS = ", ".join(f"bool_or({' OR '.join(f"contains(raw, '{m}')" for m in ms)}) AS h_{k}" for k, (n, ms) in _MARK_LISTS.items())
_ORDER = ["shopify", "woocommerce", "wordpress", "webflow", "wix", "squarespace", "nextjs"]
_ADVICE = """CASE family WHEN 'links' THEN 'Point the links at pages that answer, or redirect the old addresses.' WHEN 'titles' THEN 'Give every page a title of its own of at most 60 characters.' WHEN 'descriptions' THEN 'Describe every page in 120 to 158 characters.'
  WHEN 'structured_data' THEN 'Describe the page''s subject in JSON-LD and validate it.' WHEN 'product_urls' THEN 'Link to products by their own URL and not by a collection''s.' WHEN 'loading' THEN 'Load the main image first and scripts later.' ELSE 'Review the pages listed and scan again.' END"""
_RECS = f"""rec AS (SELECT scan_id, code, severity, affected, CASE WHEN severity IN ('critical','high') THEN 'high' ELSE 'medium' END AS priority,
  CASE WHEN code IN ('BROKEN_INTERNAL_LINK','PAGE_NOT_FOUND_4XX') THEN 'links' WHEN code IN ('MISSING_TITLE','DUPLICATE_TITLE') THEN 'titles' WHEN code = 'MISSING_META_DESCRIPTION' THEN 'descriptions'
       WHEN code IN ('MISSING_STRUCTURED_DATA','MISSING_PRODUCT_SCHEMA') THEN 'structured_data' WHEN code = 'SHOPIFY_COLLECTION_PRODUCT_DUPLICATE' THEN 'product_urls' WHEN code IN ('POOR_LCP','NEEDS_WORK_LCP') THEN 'loading' ELSE 'other' END AS family
  FROM (SELECT scan_id, code, count(*) AS affected, arg_min(severity, issue_id) AS severity FROM i GROUP BY scan_id, code)),
rec2 AS (SELECT *, CASE family WHEN 'other' THEN 90 WHEN 'structured_data' THEN 60 WHEN 'loading' THEN 60 ELSE 30 END AS phase, CASE WHEN family IN ('links','titles','descriptions','product_urls') THEN 'quick_win' ELSE 'moderate' END AS effort,
  CASE family WHEN 'other' THEN priority WHEN 'descriptions' THEN 'medium' ELSE 'high' END AS impact FROM rec),
rec3 AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY (effort = 'quick_win' AND impact = 'high') DESC, {_RANK}, affected DESC, code) AS rank FROM rec2 QUALIFY rank <= 10)"""

_PTS = f"""pts AS (SELECT scan_id, {_POINTS}, {_HOLDS} FROM (SELECT scan_id, lower(coalesce(url, '')) AS u, coalesce(body_text, '') || ' ' || coalesce(headers::VARCHAR, '') || ' ' || coalesce(images::VARCHAR, '') || ' ' || coalesce(internal_links::VARCHAR, '') AS raw
        FROM p QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY page_ord, page_id) <= 10) GROUP BY scan_id),
platform AS (SELECT scan_id, CASE {" ".join(f"WHEN {k} >= 4 THEN '{k}'" for k in _ORDER)} ELSE 'custom' END AS platform, CASE {" ".join(f"WHEN {k} >= 4 THEN least(100, {k} * 20)" for k in _ORDER)} ELSE 50 END::INTEGER AS confidence,
        concat_ws(',', {", ".join(f"CASE WHEN h_{k} THEN '{k}' END" for k in sorted(_ORDER))}) AS signals FROM pts)"""
_SITE = "(SELECT page_id, platform, lower(p.url) AS u, lower(coalesce(canonical_url, '')) AS c, coalesce(len(list_filter(structured_data_types, lambda t: contains(lower(t), 'product'))), 0) > 0 AS typed FROM p JOIN platform USING (scan_id))"
_NICHE = f"""SELECT page_id, 'SHOPIFY_COLLECTION_PRODUCT_DUPLICATE' AS code, 'high' AS severity FROM {_SITE} WHERE platform = 'shopify' AND contains(u, '/collections/') AND contains(u, '/products/') AND (c = '' OR contains(c, '/collections/') AND contains(c, '/products/'))
        UNION ALL SELECT page_id, 'SHOPIFY_VARIANT_PARAM_BLOAT', 'medium' FROM {_SITE} WHERE platform = 'shopify' AND (contains(u, '?variant=') OR contains(u, '&variant='))
        UNION ALL SELECT page_id, 'MISSING_PRODUCT_SCHEMA', 'high' FROM {_SITE} WHERE platform = 'shopify' AND (contains(u, '/products/') OR contains(u, '/product/')) AND NOT typed
        UNION ALL SELECT page_id, 'WORDPRESS_ATTACHMENT_PAGE_BLOAT', 'medium' FROM {_SITE} WHERE platform IN ('wordpress', 'woocommerce') AND (contains(u, 'attachment_id=') OR contains(u, '/attachment/'))"""
_NEAR = """s AS (SELECT sim.page_id, p.scan_id, p.url, page_ord, simhash FROM sim JOIN p USING (page_id) WHERE chars >= 50),
near AS (SELECT a.scan_id, a.page_id AS id_a, b.page_id AS id_b, b.url AS url_b, a.page_ord AS ord_a, b.page_ord AS ord_b, hamming(a.simhash, b.simhash)::INTEGER AS distance FROM s a JOIN s b ON a.scan_id = b.scan_id AND (a.page_ord < b.page_ord OR a.page_ord = b.page_ord AND a.page_id < b.page_id) WHERE hamming(a.simhash, b.simhash) BETWEEN 1 AND 6)"""
_TARGETS = f"targets AS (SELECT scan_id, {_normal('l.url')} AS u FROM links UNION SELECT scan_id, {_normal('root_url')} FROM sc)"
_ORPHANS = f"SELECT p.scan_id, page_id, p.url, page_ord FROM p WHERE NOT EXISTS (SELECT 1 FROM targets WHERE targets.scan_id = p.scan_id AND targets.u = {_normal('p.url')})"
_STEPS = """CASE family WHEN 'titles' THEN CASE WHEN platform IN ('shopify', 'wordpress', 'woocommerce') THEN 3 ELSE 2 END WHEN 'descriptions' THEN 2 WHEN 'product_urls' THEN 2 WHEN 'other' THEN 2 ELSE 3 END"""
_PROBLEM = """CASE family WHEN 'links' THEN affected || ' links or pages lead to an error.' WHEN 'titles' THEN affected || ' pages have no title of their own.' WHEN 'descriptions' THEN affected || ' pages have no description.'
        WHEN 'structured_data' THEN affected || ' pages have no structured data.' WHEN 'product_urls' THEN affected || ' products are reached below collections.' WHEN 'loading' THEN 'The main content of ' || affected || ' pages appears late.' ELSE affected || ' cases of: ' || coalesce(title, code) END"""

SQL = {
    "page_issue_rows": _WITH(_P, _JUMPS) + f"SELECT page_id, code, category, severity FROM ({_RULES})",
    "heading_jumps": _WITH(_P, _JUMPS) + "SELECT page_id, jumped_from, jumped_to FROM jumps",
    "issue_code_counts": _WITH(_P, _JUMPS, _LINKS, _STATUS) + f"""SELECT code, severity, count(*) AS n FROM (SELECT code, severity FROM ({_RULES})
        UNION ALL SELECT 'DUPLICATE_TITLE', 'high' FROM {_DUP('title', 0)} WHERE n > 1 UNION ALL SELECT 'DUPLICATE_META_DESCRIPTION', 'medium' FROM {_DUP('meta_description', 10)} WHERE n > 1
        UNION ALL SELECT 'BROKEN_INTERNAL_LINK', 'critical' FROM ({_BROKEN}) UNION ALL SELECT 'REDIRECT_CHAIN', 'medium' FROM ({_REDIR}) UNION ALL SELECT 'BROKEN_EXTERNAL_LINK', 'medium' FROM ({_EXT})) GROUP BY code, severity""",
    "duplicate_titles": _WITH(_P) + f"SELECT page_id, n FROM {_DUP('title', 0)} WHERE n > 1",
    "duplicate_descriptions": _WITH(_P) + f"SELECT page_id, n FROM {_DUP('meta_description', 10)} WHERE n > 1",
    "links_exploded": _WITH(_P, _LINKS) + "SELECT page_id, link_ord, l.url AS target_url, l.anchor_text AS anchor_text FROM links",
    "link_counts": _WITH(_P) + "SELECT page_id, coalesce(len(internal_links), 0) AS n_internal, coalesce(len(external_links), 0) AS n_external, coalesce(len(list_filter(images, lambda x: x.alt IS NULL OR trim(x.alt) = '')), 0) AS n_no_alt FROM p",
    "broken_links": _WITH(_P, _LINKS, _STATUS) + _BROKEN,
    "external_broken": _WITH(_P) + _EXT,
    "redirected": _WITH(_P, _LINKS) + _REDIR,
    "exact_duplicates": _WITH(_DOC) + f"SELECT md5({_NORM}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM d WHERE length(text) >= 50 GROUP BY 1 HAVING count(*) > 1",
    "duplicate_content": _WITH(_P) + f"SELECT page_id, 'EXACT_DUPLICATE_CONTENT' AS code FROM (SELECT page_id, count(*) OVER (PARTITION BY scan_id, md5({_NORM.replace('text', 'body_text')})) AS n FROM p WHERE length(body_text) >= 50) WHERE n > 1",
    "simhashes": _WITH(_DOC, _SIM) + "SELECT doc_id, simhash FROM sim",
    "near_hash_pairs": _WITH(_DOC, _SIM, "h AS (SELECT DISTINCT simhash AS s FROM sim WHERE chars >= 50)") + "SELECT a.s AS hash_a, b.s AS hash_b, CAST(hamming(a.s, b.s) AS INTEGER) AS distance FROM h a JOIN h b ON a.s < b.s WHERE hamming(a.s, b.s) <= 4",
    "shingle_counts": _WITH(_DOC, _SHINGLES) + f"SELECT doc_id, len(s) AS n_shingles, md5({_NORM}) AS content_hash FROM sh",
    "readability": _WITH(_DOC) + f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN t = '' THEN 0 ELSE CAST(floor(greatest(0.0, least(100.0, 206.835 - 1.015 * (n / s) - 84.6 * (y / n))) + 0.5) AS INTEGER) END AS flesch FROM (
        SELECT doc_id, text, t, CAST(len(w) AS DOUBLE) AS n, greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: {_TRIM('x')} <> ''))) AS s,
          list_sum(list_transform(list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]{{1,2}}'))
            - CASE WHEN x LIKE '%e' AND x NOT LIKE '%le' AND len(regexp_extract_all(x, '[aeiouy]{{1,2}}')) > 1 THEN 1 ELSE 0 END) END)) AS y
        FROM (SELECT doc_id, text, t, string_split(t, ' ') AS w FROM (SELECT doc_id, text, {_TRIM(f"regexp_replace(text, '{_W}+', ' ', 'g')")} AS t FROM d)))""",
    "url_quality": _WITH(_SP) + f"""SELECT page_id, nullif(lower(regexp_extract(trim(url), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS url_host, {_PATH('trim(url)')} AS url_path, length(url) > 100 AS long,
        regexp_matches({_PATH('trim(url)')}, '[A-Z]') AS capitals, contains({_PATH('trim(url)')}, '_') AS underscores, {_FIELDS('url')} AS n_fields FROM sp""",
    "vitals": _WITH(_P) + """SELECT page_id, CAST(greatest(20, least(99, 100 - CASE WHEN lcp > 250 THEN 18 ELSE 0 END - CASE WHEN lcp > 400 THEN 15 ELSE 0 END - CASE WHEN cls > 10 THEN 12 ELSE 0 END - CASE WHEN cls > 25 THEN 12 ELSE 0 END
        - CASE WHEN tbt > 200 THEN 12 ELSE 0 END - CASE WHEN tbt > 600 THEN 12 ELSE 0 END - CASE WHEN fcp > 180 THEN 8 ELSE 0 END)) AS INTEGER) AS perf_score, lcp, fcp, cls, tbt, inp FROM (
        SELECT page_id, CAST(floor(least(6.0::DOUBLE, 0.9::DOUBLE + rt * 1.8::DOUBLE + CASE WHEN n > 10 THEN 1.0::DOUBLE ELSE n * 0.05::DOUBLE END) * 100 + 0.5::DOUBLE) AS INTEGER) AS lcp,
          CAST(floor(least(4.0::DOUBLE, 0.6::DOUBLE + rt * 1.3::DOUBLE) * 100 + 0.5::DOUBLE) AS INTEGER) AS fcp, CASE WHEN n > 8 THEN 14 WHEN n > 3 THEN 6 ELSE 2 END AS cls,
          least(900, CAST(floor(60 + w / 25.0::DOUBLE + n * 14 + 0.5::DOUBLE) AS INTEGER)) AS tbt, least(500, CAST(100 + n * 12 AS INTEGER)) AS inp
        FROM (SELECT page_id, coalesce(response_time_ms, 500) / 1000.0::DOUBLE AS rt, coalesce(len(images), 0) AS n, coalesce(word_count, 500) AS w FROM p))""",
    "vitals_issues": """WITH m AS (SELECT DISTINCT ON (metric_id) * FROM page_metrics) SELECT metric_id, 'POOR_LCP' AS code, 'high' AS severity FROM m WHERE lcp > 4.0 UNION ALL SELECT metric_id, 'NEEDS_WORK_LCP', 'medium' FROM m WHERE lcp > 2.5 AND lcp <= 4.0
        UNION ALL SELECT metric_id, 'POOR_CLS', 'high' FROM m WHERE cls > 0.25 UNION ALL SELECT metric_id, 'POOR_TBT', 'high' FROM m WHERE tbt > 600""",
    "metric_defaults": "SELECT DISTINCT ON (metric_id) metric_id, page_id, coalesce(perf_score, 85) AS perf_score, coalesce(lcp, 2.1) AS lcp, coalesce(inp, 120) AS inp, coalesce(cls, 0.04) AS cls, coalesce(fcp, 1.2) AS fcp, coalesce(tbt, 150) AS tbt FROM page_metrics",
    "severity_pivot": _WITH(_IS) + "SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM i GROUP BY scan_id",
    "scan_scores": _WITH(_IS, _SC, _SP, "pm AS (SELECT page_id, min(perf_score) AS ps FROM page_metrics GROUP BY page_id)", "perf AS (SELECT scan_id, min(ps) AS ps FROM sp JOIN pm USING (page_id) GROUP BY scan_id)",
        f"lost AS (SELECT scan_id, category, sum({_PENALTY}) AS x FROM i GROUP BY ALL)",
        "base AS (SELECT sc.scan_id, any_value(ps) AS ps, coalesce(sum(x) FILTER (category = 'technical'), 0) AS t, coalesce(sum(x) FILTER (category = 'onpage'), 0) AS o, coalesce(sum(x) FILTER (category = 'performance'), 0) AS f, coalesce(sum(x) FILTER (category = 'security'), 0) AS s, coalesce(sum(x) FILTER (category = 'accessibility'), 0) AS a FROM sc LEFT JOIN perf USING (scan_id) LEFT JOIN lost USING (scan_id) GROUP BY sc.scan_id)",
        "cat AS (SELECT scan_id, greatest(0, 100 - t)::INTEGER AS technical, greatest(0, 100 - o)::INTEGER AS onpage, (CASE WHEN ps IS NULL THEN greatest(0, 100 - f) ELSE floor(greatest(0.0, least(100.0, ps - (100 - greatest(0, ps - f)) * 0.5)) + 0.5) END)::INTEGER AS performance, greatest(0, 100 - s)::INTEGER AS security, greatest(0, 100 - a)::INTEGER AS accessibility FROM base)",
        "tot AS (SELECT *, ((30 * technical + 25 * onpage + 25 * performance + 10 * security + 10 * accessibility + 50) // 100)::INTEGER AS overall FROM cat)") + "SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 75 THEN 'B' WHEN overall >= 60 THEN 'C' WHEN overall >= 45 THEN 'D' ELSE 'F' END AS grade FROM tot",
    "top_deductions": _WITH(_IS) + f"""SELECT scan_id, rank, category, code, severity, deduction, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY deduction DESC, first_id, category, code) AS rank FROM (
        SELECT scan_id, category, code, sum({_PENALTY}) AS deduction, count(*) AS n, min(issue_id) AS first_id, arg_min(severity, issue_id) AS severity FROM i GROUP BY scan_id, category, code)) WHERE rank <= 5""",
    "issue_groups": _WITH(_IS, _SP) + f"""SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY {_RANK}, n DESC, code) AS rank, code, severity, n, n_urls FROM (
        SELECT i.scan_id, code, count(*) AS n, arg_min(severity, issue_id) AS severity, count(DISTINCT url) AS n_urls FROM i LEFT JOIN sp USING (page_id) GROUP BY i.scan_id, code)""",
    "first_issues": _WITH(_IS) + "SELECT scan_id, code, row_number() OVER (PARTITION BY scan_id, code ORDER BY issue_id) AS rank, issue_id FROM i QUALIFY rank <= 3",
    "issues_with_pages": _WITH(_IS, _SP) + "SELECT issue_id, url, status_code FROM i LEFT JOIN sp USING (page_id)",
    "issue_filter": _WITH(_IS) + "SELECT issue_id, scan_id, code FROM i WHERE category = 'technical' AND severity = 'critical'",
    "page_search": _WITH(_SP) + "SELECT page_id, url, title FROM sp WHERE (contains(lower(url), 'garden') OR contains(lower(title), 'garden')) AND status_code = 200",
    "page_list": _WITH(_IS, _SP) + "SELECT page_id, url, depth, count(issue_id) AS n_issues FROM (SELECT page_id, url, depth FROM sp ORDER BY depth NULLS FIRST, page_id LIMIT 50 OFFSET 50) LEFT JOIN i USING (page_id) GROUP BY page_id, url, depth",
    "recent_scans": _WITH(_SC) + "SELECT scan_id, root_url, status, created_at FROM sc ORDER BY created_at DESC NULLS LAST, scan_id LIMIT 20",
    "scan_summary": _WITH(_IS, _SC, _SP) + """SELECT scan_id, root_url, status, overall_score, coalesce(n_pages, 0) AS n_pages, coalesce(n, 0) AS n_issues, coalesce(c, 0) AS critical, coalesce(h, 0) AS high, coalesce(m, 0) AS medium, coalesce(l, 0) AS low FROM sc
        LEFT JOIN (SELECT scan_id, count(*) AS n_pages FROM sp GROUP BY scan_id) USING (scan_id)
        LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l FROM i GROUP BY scan_id) USING (scan_id)""",
    "export_issues": _WITH(_IS, _SC, _SP) + """SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY first_id) AS row, code, n, message, url FROM (
        SELECT i.scan_id, code, count(*) AS n, min(issue_id) AS first_id, arg_min_null(message, issue_id) AS message, arg_min_null(coalesce(url, root_url), issue_id) AS url FROM i LEFT JOIN sp USING (page_id) JOIN sc ON sc.scan_id = i.scan_id GROUP BY i.scan_id, code)""",
    "root_pages": _WITH(_SC, _SP) + "SELECT sp.scan_id, page_id FROM sp JOIN sc USING (scan_id) QUALIFY row_number() OVER (PARTITION BY sp.scan_id ORDER BY coalesce(url = root_url, false) DESC, page_ord, page_id) = 1",
    "nested_scans": _WITH(_SC, _P) + "SELECT scan_id, coalesce(n, 0) AS n_pages, first_page FROM sc LEFT JOIN (SELECT scan_id, count(*) AS n, arg_min(page_id, page_ord * 100000000000 + page_id) AS first_page FROM p GROUP BY scan_id) USING (scan_id)",
    "pages_with_metrics": _WITH(_SP) + "SELECT page_id, perf_score, tbt FROM sp JOIN (SELECT DISTINCT ON (page_id) * FROM page_metrics) USING (page_id) WHERE perf_score IS NOT NULL",
    "recommendations": _WITH(_IS, _RECS) + "SELECT scan_id, rank, code, phase, priority, effort, affected FROM rec3",
    "recommendation_texts": _WITH(_IS, _SP, _P, _PTS, _RECS) + f"""SELECT rec3.scan_id, rank, code, coalesce(platform, 'custom') AS platform, {_PROBLEM} AS problem, {_STEPS} AS n_steps,
        CASE family WHEN 'links' THEN 'apache' WHEN 'structured_data' THEN 'json' WHEN 'product_urls' THEN 'liquid' WHEN 'other' THEN NULL ELSE 'html' END AS language, coalesce(urls, '') AS sample_pages
        FROM rec3 LEFT JOIN platform USING (scan_id) LEFT JOIN (SELECT scan_id, code, arg_min_null(title, issue_id) AS title FROM i GROUP BY scan_id, code) USING (scan_id, code)
        LEFT JOIN (SELECT scan_id, code, string_agg(url, ' ' ORDER BY issue_id) AS urls FROM (SELECT i.scan_id, code, issue_id, url FROM i JOIN sp USING (page_id) WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY i.scan_id, code ORDER BY issue_id) <= 3) GROUP BY scan_id, code) USING (scan_id, code)""",
    "weighted_mean": "SELECT l_returnflag AS flag, sum(l_linenumber)::BIGINT AS clicks, sum(l_quantity::INTEGER)::BIGINT AS impressions, floor(sum(l_linenumber) * 100.0::DOUBLE / sum(l_quantity::INTEGER) * 100 + 0.5)::BIGINT AS ctr_hundredths, floor(sum(floor(l_extendedprice)::BIGINT * l_quantity::INTEGER)::DOUBLE / sum(l_quantity::INTEGER) * 10 + 0.5)::BIGINT AS position_tenths FROM lineitem GROUP BY l_returnflag",
    "normal_urls": _WITH(_SP) + f"SELECT scan_id, {_normal('url')} AS normal_url, count(*) AS n, count(DISTINCT url) AS spellings FROM sp GROUP BY ALL",
    "orphan_pages": _WITH(_P, _SC, _LINKS, f"t AS (SELECT scan_id, {_normal('l.url')} AS u FROM links UNION SELECT scan_id, {_normal('root_url')} FROM sc)") + f"SELECT p.scan_id, page_id, url FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.scan_id = p.scan_id AND t.u = {_normal('p.url')})",
    "platforms": _WITH(_P, _PTS) + "SELECT * FROM platform",
    "platform_rules": _WITH(_P, _PTS) + f"SELECT page_id, code FROM ({_NICHE})",
    "near_duplicate_rule": _WITH(_P, _PSIM, _NEAR) + "SELECT scan_id, id_a AS page_id, 'NEAR_DUPLICATE_CONTENT' AS code, url_b FROM near WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord_a, ord_b) <= 10",
    "found_issue_counts": _WITH(_P, _JUMPS, _LINKS, _STATUS, _SC, _SP, _PTS, _PSIM, _NEAR, _TARGETS, "m AS (SELECT DISTINCT ON (metric_id) * FROM page_metrics)") + f"""SELECT code, severity, count(*) AS n FROM (SELECT code, severity FROM ({_RULES})
        UNION ALL SELECT 'DUPLICATE_TITLE', 'high' FROM {_DUP('title', 0)} WHERE n > 1 UNION ALL SELECT 'DUPLICATE_META_DESCRIPTION', 'medium' FROM {_DUP('meta_description', 10)} WHERE n > 1
        UNION ALL SELECT 'BROKEN_INTERNAL_LINK', 'critical' FROM ({_BROKEN}) UNION ALL SELECT 'REDIRECT_CHAIN', 'medium' FROM ({_REDIR}) UNION ALL SELECT 'BROKEN_EXTERNAL_LINK', 'medium' FROM ({_EXT})
        UNION ALL SELECT 'EXACT_DUPLICATE_CONTENT', 'medium' FROM (SELECT count(*) OVER (PARTITION BY scan_id, md5({_NORM.replace('text', 'body_text')})) AS n FROM p WHERE length(body_text) >= 50) WHERE n > 1
        UNION ALL SELECT 'NEAR_DUPLICATE_CONTENT', 'medium' FROM (SELECT 1 FROM near WHERE distance <= 3 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord_a, ord_b) <= 10)
        UNION ALL SELECT 'ORPHAN_PAGE', 'low' FROM (SELECT 1 FROM ({_ORPHANS}) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY page_ord, url) <= 10)
        UNION ALL SELECT code, severity FROM ({_NICHE})
        UNION ALL SELECT 'POOR_LCP', 'high' FROM m WHERE lcp > 4.0 UNION ALL SELECT 'NEEDS_WORK_LCP', 'medium' FROM m WHERE lcp > 2.5 AND lcp <= 4.0 UNION ALL SELECT 'POOR_CLS', 'high' FROM m WHERE cls > 0.25 UNION ALL SELECT 'POOR_TBT', 'high' FROM m WHERE tbt > 600) GROUP BY code, severity""",
    "issue_group_urls": _WITH(_IS, _SP) + "SELECT i.scan_id, code, min(issue_id) AS first_id, url AS page_url FROM i JOIN sp USING (page_id) WHERE url IS NOT NULL GROUP BY i.scan_id, code, url",
    "shared_title_urls": _WITH(_P) + f"SELECT scan_id, title, row_number() OVER (PARTITION BY scan_id, title ORDER BY page_ord NULLS FIRST, page_id) - 1 AS ord, page_id, url FROM (SELECT scan_id, lower({_T}) AS title, page_ord, page_id, url, count(*) OVER (PARTITION BY scan_id, lower({_T})) AS n FROM p WHERE length({_T}) > 0) WHERE n > 1",
    "scan_pages": _WITH(_SP) + "SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY page_ord NULLS FIRST, page_id) - 1 AS ord, page_id FROM sp",
    "page_total": _WITH(_SP) + "SELECT count(*) AS total, ceil(count(*) / 50.0)::BIGINT AS pages FROM sp WHERE (contains(lower(url), 'garden') OR contains(lower(title), 'garden')) AND status_code = 200",
    "opportunity_rows": _WITH(_P) + """SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY kind) - 1)::INTEGER AS ord, kind, savings_ms FROM (
        SELECT page_id, 'images' AS kind, n * 60::BIGINT AS savings_ms FROM (SELECT page_id, coalesce(len(images), 0) AS n FROM p) WHERE n > 5
        UNION ALL SELECT page_id, 'server', (lcp - 250) * 10 FROM (SELECT page_id, CAST(floor(least(6.0::DOUBLE, 0.9::DOUBLE + rt * 1.8::DOUBLE + CASE WHEN n > 10 THEN 1.0::DOUBLE ELSE n * 0.05::DOUBLE END) * 100 + 0.5::DOUBLE) AS BIGINT) AS lcp
          FROM (SELECT page_id, coalesce(response_time_ms, 500) / 1000.0::DOUBLE AS rt, coalesce(len(images), 0) AS n FROM p)) WHERE lcp > 250)""",
    "near_duplicate_pages": _WITH(_P, _PSIM, "s AS (SELECT sim.page_id, p.scan_id, page_ord, simhash FROM sim JOIN p USING (page_id) WHERE chars >= 50)")
    + "SELECT a.scan_id, a.page_id AS id_a, b.page_id AS id_b, hamming(a.simhash, b.simhash)::INTEGER AS distance, floor((64 - hamming(a.simhash, b.simhash)) / 64.0 * 100 + 0.5)::INTEGER AS similarity FROM s a JOIN s b ON a.scan_id = b.scan_id AND (a.page_ord < b.page_ord OR a.page_ord = b.page_ord AND a.page_id < b.page_id) WHERE hamming(a.simhash, b.simhash) BETWEEN 1 AND 6",
    "action_plan": _WITH(_IS, _RECS) + f"SELECT * FROM (SELECT scan_id, phase, {_ADVICE} AS advice, min(rank) AS rank FROM rec3 GROUP BY scan_id, phase, advice) QUALIFY row_number() OVER (PARTITION BY scan_id, phase ORDER BY rank) <= 6",
    "opportunities": "SELECT DISTINCT ON (metric_id) metric_id, coalesce(json_array_length(opportunities), 0)::INTEGER AS n_opportunities FROM page_metrics",
}

SQL["executive_summaries"] = _WITH(_SC, _IS, _P, _PTS, f"sco AS ({SQL['scan_scores']})", "grp AS (SELECT scan_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM (SELECT scan_id, code, arg_min(severity, issue_id) AS severity FROM i GROUP BY scan_id, code) GROUP BY scan_id)") + """SELECT scan_id,
    coalesce(nullif(lower(regexp_extract(trim(root_url), '(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), 'website') || ': Score ' || overall || ' of 100, grade ' || grade || '; ' || coalesce(c, 0) || ' critical and ' || coalesce(h, 0) || ' high kinds of issue. Platform: ' || coalesce(platform, 'custom') || '.' AS summary
    FROM sco LEFT JOIN grp USING (scan_id) LEFT JOIN sc USING (scan_id) LEFT JOIN platform USING (scan_id)"""
