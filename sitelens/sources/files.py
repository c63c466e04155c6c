"""Sources: stored pages, robots.txt, sitemaps, page-speed and search reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import cut

#: Most addresses of a sitemap, most children of an index.
MOST_URLS, MOST_CHILDREN = 500, 5
#: Page-speed audits that count as opportunities below a score of 0.9.
OPPORTUNITIES = ["render-blocking-resources", "unused-javascript", "unused-css-rules", "modern-image-formats", "uses-optimized-images", "uses-text-compression", "uses-responsive-images"]


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages (url, html) as fetched before; missing transport columns are filled with those of a page that loaded."""
    raw = spark.read.parquet(path)
    fill = {"status_code": F.lit(200), "depth": F.lit(0), "response_time_ms": F.lit(0), "headers": F.create_map().cast("map<string,string>"), "ssl_valid": F.lit(None).cast("boolean"), "ssl_days_remaining": F.lit(None).cast("int")}
    return raw.withColumns({c: v for c, v in fill.items() if c not in raw.columns})


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages from files: the file name stands for the URL."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def days_left(valid_to: Column, now: Column | None = None) -> Column:
    """Whole days until a certificate ends, never below 0."""
    seconds = F.unix_timestamp(valid_to) - F.unix_timestamp(now if now is not None else F.current_timestamp())
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(host, allow, pattern, rank): the path rules of (host, text) that hold for an agent.

    Groups naming the agent go before those for any agent; an empty Disallow
    allows everything and is no rule.
    """

    def read(text: str | None) -> list[tuple[bool, str]]:
        groups: list[tuple[set[str], list[tuple[bool, str]]]] = []
        fresh = False
        for line in (text or "").splitlines():
            key, _, value = line.split("#")[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if key == "user-agent":
                if not fresh:
                    groups.append((set(), []))
                groups[-1][0].add(value.lower())
                fresh = True
            elif key in ("allow", "disallow") and groups:
                fresh = False
                if value:
                    groups[-1][1].append((key == "allow", value))
        own = [r for names, rules in groups if any(n != "*" and n in agent.lower() for n in names) for r in rules]
        named = any(n != "*" and n in agent.lower() for names, _ in groups for n in names)
        return own if named else [r for names, rules in groups if "*" in names for r in rules]

    udf = F.udf(read, "array<struct<allow:boolean,pattern:string>>")
    return files.select("host", F.posexplode(udf("text")).alias("rank", "r")).select("host", "r.allow", "r.pattern", "rank")


def disallowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, and more) with column disallowed: the longest matching pattern decides, Allow wins a tie."""
    quoted = F.regexp_replace("pattern", r"([.+?^()\[\]{}|\\])", r"\\$1")
    ready = rules.withColumn("regex", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\\$")))
    by = ready.groupBy("host").agg(F.collect_list(F.struct("regex", "allow", F.length("pattern").alias("n"))).alias("rules"))
    best = F.array_max(F.transform(F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["regex"])), lambda r: F.struct(r["n"], r["allow"])))
    return urls.join(by, "host", "left").withColumn("disallowed", F.coalesce(~best["allow"], F.lit(False))).drop("rules")


def sitemap_lines(files: DataFrame) -> DataFrame:
    """(host, sitemap_url) named in (host, text) of robots.txt, else the usual place."""
    named = F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    usual = F.array(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")))
    return files.select("host", F.explode(F.when(F.size(named) > 0, named).otherwise(usual)).alias("sitemap_url"))


def sitemap_urls(roots: DataFrame, files: DataFrame, depth: int = 5, most: int = MOST_URLS) -> DataFrame:
    """(root, url, ord): addresses of the sitemaps ``roots`` (sitemap_url), read from ``files`` (sitemap_url, xml).

    An index leads to its first five children, level by level, each file once.
    Addresses are distinct, in order, at most ``most`` for each root.
    """
    loc = lambda tag: F.transform(F.regexp_extract_all("xml", F.lit(rf"(?is)<{tag}>.*?<loc>([^<]+)</loc>.*?</{tag}>"), F.lit(1)), lambda u: F.trim(u))
    any_loc = F.filter(F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>([^<]+)</loc>"), F.lit(1)), lambda u: F.trim(u)), lambda u: ~u.endswith(".xml"))
    read = files.select("sitemap_url", loc("sitemap").alias("children"), F.when(F.size(loc("url")) > 0, loc("url")).otherwise(any_loc).alias("urls"))
    level = roots.select(F.col("sitemap_url").alias("root"), "sitemap_url", F.lit("").alias("place"))
    seen, out = level.select("root", "sitemap_url"), None
    for _ in range(depth):
        hit = cut(level.join(read, "sitemap_url"))
        leaf = hit.where(F.size("children") == 0).select("root", "place", F.posexplode("urls").alias("pos", "url"))
        out = leaf if out is None else out.unionByName(leaf)
        more = hit.select("root", "place", F.posexplode(F.slice("children", 1, MOST_CHILDREN)).alias("pos", "sitemap_url"))
        level = more.select("root", "sitemap_url", F.concat("place", F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit("/")).alias("place")).join(seen, ["root", "sitemap_url"], "left_anti").dropDuplicates(["root", "sitemap_url"])
        level = cut(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("root", "sitemap_url"))
    first = out.groupBy("root", "url").agg(F.min(F.struct("place", "pos")).alias("at"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("root").orderBy("at"))
    return first.select("root", "url", (rank - 1).alias("ord")).where(F.col("ord") < most)


def page_speed(spark: SparkSession, path: str) -> DataFrame:
    """Vitals from stored page-speed answers (one JSON document for each line): (url, perf_score, lcp, inp, cls, fcp, tbt, opportunities)."""
    audit = "struct<score:double,numericValue:double,title:string,displayValue:string>"
    schema = f"id string, lighthouseResult struct<finalUrl:string,categories:struct<performance:struct<score:double>>,audits:map<string,{audit}>>"
    return vitals_of(spark.read.schema(schema).json(path))


def vitals_of(answers: DataFrame) -> DataFrame:
    lh = F.col("lighthouseResult")
    value = lambda k: F.coalesce(lh["audits"][k]["numericValue"], F.lit(0.0))
    two = lambda c, n=100: F.floor(c * n + 0.5) / n
    kept = F.filter(F.transform(F.array(*map(F.lit, OPPORTUNITIES)), lambda k: lh["audits"][k]), lambda a: a["score"].isNotNull() & (a["score"] < 0.9))
    return answers.select(
        F.coalesce(lh["finalUrl"], "id").alias("url"), F.floor(F.coalesce(lh["categories"]["performance"]["score"], F.lit(0.0)) * 100 + 0.5).cast("int").alias("perf_score"),
        two(value("largest-contentful-paint") / 1000).alias("lcp"), F.floor(value("interaction-to-next-paint") + 0.5).cast("int").alias("inp"), two(value("cumulative-layout-shift"), 1000).alias("cls"),
        two(value("first-contentful-paint") / 1000).alias("fcp"), F.floor(value("total-blocking-time") + 0.5).cast("int").alias("tbt"), F.transform(kept, lambda a: F.struct(a["title"].alias("title"), a["displayValue"].alias("savings"))).alias("opportunities"),
    )


def search_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows (keys, clicks, impressions, ctr, position) of stored search reports."""
    schema = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"
    return spark.read.schema(schema).json(path).select(F.explode("rows").alias("r")).select("r.*")


def fetched(urls: DataFrame, fetch: Callable[[str], dict]) -> DataFrame:
    """Pages by a fetcher of the caller's, at most one partition for each host so that the fetcher can pace itself.

    ``fetch`` gives a dict of status_code, final_url, html, headers and response_time_ms; an error becomes status 500 without text.
    """
    from sitelens.functions.urls import url_host

    ddl = "url string, final_url string, status_code int, html string, headers map<string,string>, response_time_ms int"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    got = fetch(url)
                except Exception:
                    got = {"status_code": 500, "html": ""}
                rows.append((url, got.get("final_url", url), got.get("status_code", 200), got.get("html"), {k.lower(): v for k, v in (got.get("headers") or {}).items()}, got.get("response_time_ms", 0)))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status_code", "html", "headers", "response_time_ms"])

    return urls.select("url").repartition(url_host(F.col("url"))).mapInPandas(run, ddl)


