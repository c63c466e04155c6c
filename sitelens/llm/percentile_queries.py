"""Percentiles of response times and word counts per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.percentiles import counted, first_histogram, select_ranks
from sitelens.session import cut
from sitelens.tables import latest, load

PROBABILITIES = (0.5, 0.9, 0.95, 0.99)


def site_key(url: Column) -> Column:
    """One spelling for a site: no scheme, user, default port, path or trailing dot, in lower case."""
    return F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?|\.?(?::(?:80|443))?(?:[/?#].*)?$", "")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by site, day, metric and value. A response time below 0 was not measured."""
    pages = latest(load(spark, folder, "site_pages").select("page_id", "scan_id", "response_time_ms", "word_count", "fetched_at", "ingested_at"), "page_id")
    scans = latest(load(spark, folder, "scans").select("scan_id", "root_url", "ingested_at"), "scan_id")
    rows = pages.join(scans.select("scan_id", site_key(F.col("root_url")).alias("site")), "scan_id").select(
        "site", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), F.when(F.col("response_time_ms") >= 0, F.col("response_time_ms")).alias("response_time_ms"), "word_count"
    )
    return counted(rows, ["site"], ["day"], ["response_time_ms", "word_count"])


def p6_site_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return select_ranks(cut(state(spark, folder)), ["site"], PROBABILITIES)


def p6_day_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """The first digit's histogram of each site and day, good to 1/16 of a value: for a look at it; ``p6_day_states`` is what days hand over."""
    return first_histogram(state(spark, folder), ["site", "day"])


def p6_day_states(spark: SparkSession, folder: str) -> DataFrame:
    """Counts (site, day, metric, key, n): what separate days hand over; percentiles of their union are those of all days."""
    return state(spark, folder)


QUERIES = {"p6_site_percentiles": p6_site_percentiles, "p6_day_histograms": p6_day_histograms, "p6_day_states": p6_day_states}

_VALUES = """
WITH pages AS (SELECT * FROM site_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC) = 1),
sites AS (SELECT scan_id, regexp_replace(regexp_replace(lower(root_url), '^[a-z]+://', ''), '/.*$', '') AS site
          FROM scans QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at DESC) = 1),
vals AS (SELECT site, CAST(CAST(fetched_at AS DATE) AS VARCHAR) AS day, 'response_time_ms' AS metric, response_time_ms AS v FROM pages JOIN sites USING (scan_id) WHERE response_time_ms >= 0
         UNION ALL SELECT site, CAST(CAST(fetched_at AS DATE) AS VARCHAR), 'word_count', word_count FROM pages JOIN sites USING (scan_id) WHERE word_count IS NOT NULL),
-- the bits of a double: 52 for the fraction, before them the exponent
keyed AS (SELECT site, day, metric, CASE WHEN v = 0 THEN 0 ELSE (1023 + e) * 4503599627370496 + CAST((v / pow(2, e) - 1) * 4503599627370496 AS BIGINT) END AS key
          FROM (SELECT *, CASE WHEN v > 0 THEN CAST(floor(log2(v)) AS BIGINT) ELSE 0 END AS e FROM vals))
"""
SQL = {
    "p6_day_states": _VALUES + "SELECT site, day, metric, key, count(*) AS n FROM keyed GROUP BY ALL",
    "p6_day_histograms": _VALUES + "SELECT site, day, metric, key // 281474976710656 AS digit, count(*) AS n FROM keyed GROUP BY ALL",
    "p6_site_percentiles": """
WITH pages AS (SELECT * FROM site_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ingested_at DESC) = 1),
sites AS (SELECT scan_id, regexp_replace(regexp_replace(lower(root_url), '^[a-z]+://', ''), '/.*$', '') AS site
          FROM scans QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ingested_at DESC) = 1),
vals AS (SELECT site, 'response_time_ms' AS metric, response_time_ms AS v FROM pages JOIN sites USING (scan_id) WHERE response_time_ms >= 0
         UNION ALL SELECT site, 'word_count', word_count FROM pages JOIN sites USING (scan_id) WHERE word_count IS NOT NULL)
SELECT site, metric, CAST(p AS DOUBLE) AS p, n, CAST(value AS DOUBLE) AS value FROM (
  SELECT site, metric, count(*) AS n, unnest([0.5, 0.9, 0.95, 0.99]) AS p,
         unnest(quantile_disc(v, [0.5, 0.9, 0.95, 0.99])) AS value FROM vals GROUP BY site, metric)
""",
}
