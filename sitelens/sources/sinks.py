"""Sinks: tables, the four sheets of an export, and a printable report."""

from __future__ import annotations

from collections.abc import Callable
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.scores import severity_rank


def append(df: DataFrame, folder: str, by: str = "scan_id") -> None:
    """Append rows to a table partitioned by scan; a partition is written by as many tasks as its size asks for."""
    df.write.mode("append").partitionBy(by).parquet(folder)


#: The states of a scan in their order; the last two end it.
STATES = ["queued", "crawling", "analyzing", "scoring", "generating_report", "complete", "failed"]


def follows(before: str | None, after: str) -> bool:
    """Whether a scan may go from one state to another: on to the next, or from any that is not an end to failed."""
    if after not in STATES:
        raise ValueError(f"no such state: {after!r}")
    if before is None:
        return after == STATES[0]
    if before in STATES[-2:]:
        return False
    return after == "failed" or STATES.index(after) == STATES.index(before) + 1


def run_states(spark: SparkSession, scan_id: str, steps: dict[str, Callable[[], object]], note: Callable[[DataFrame], None]) -> str:
    """Run the steps of a scan (state to function) and note each state as a row (scan_id, status, at, error_text) by ``note``; the last state.

    A step that fails ends the scan as failed with the error's text; the error is not raised.
    """
    def state(name: str, error: str | None = None) -> None:
        note(spark.createDataFrame([(scan_id, name, error)], "scan_id string, status string, error_text string").withColumn("at", F.current_timestamp()))

    last = None
    for name in STATES[:-1]:
        if not follows(last, name):
            raise ValueError(f"{name} does not follow {last}")
        state(name)
        last = name
        try:
            steps.get(name, lambda: None)()
        except Exception as error:
            state("failed", str(error)[:2000])
            return "failed"
    return last


def latest_status(statuses: DataFrame) -> DataFrame:
    """The last (scan_id, status, at) of each scan: states are appended, never updated."""
    return statuses.groupBy("scan_id").agg(F.max_by("status", F.struct("at", _place(F.col("status")))).alias("status"), F.max("at").alias("at"))


def _place(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), status)


def page_rows(pages: DataFrame) -> DataFrame:
    """Crawled pages as the page table stores them: headers as JSON, main headings counted, no text."""
    kept = ["scan_id", "page_id", "page_ord", "url", "final_url", "status_code", "response_time_ms", "title", "meta_description", "canonical_url", "robots_directives", "word_count", "depth", "rendered", "content_type"]
    have = [c for c in kept if c in pages.columns]
    return pages.select(*have, F.coalesce(F.size("h1_list"), F.lit(0)).alias("h1_count"), F.to_json("headers").alias("headers"))


def link_rows(pages: DataFrame) -> DataFrame:
    """Links as the link table stores them: both kinds, ``is_external`` tells them apart."""
    one = lambda column, outer: pages.select("scan_id", F.col("page_id").alias("from_page_id"), F.posexplode(column).alias("link_ord", "l")).select("scan_id", "from_page_id", "link_ord", F.col("l.url").alias("to_url"), F.col("l.anchor_text").alias("anchor_text"), F.lit(outer).alias("is_external"), F.col("l.status_code").alias("status_code"))
    return one("internal_links", False).unionByName(one("external_links", True))


def metric_rows(vitals: DataFrame) -> DataFrame:
    """Vitals as the metric table stores them; the id is the page's."""
    return vitals.select(F.concat(F.lit("m-"), F.col("page_id").cast("string")).alias("metric_id"), "page_id", *[c for c in ("perf_score", "lcp", "inp", "cls", "fcp", "tbt") if c in vitals.columns])


def recommendation_rows(recommended: DataFrame) -> DataFrame:
    """Recommendations as their table stores them: lists and snippets as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in recommended.dtypes]
    return recommended.select(*flat)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def export_sheets(folder: str, summary: DataFrame, issues: DataFrame, pages: DataFrame, plan: DataFrame) -> None:
    """The four sheets as CSV folders with headers; lists become JSON."""
    for name, df in {"summary": summary, "issues": issues, "pages": pages, "action_plan": plan}.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def report(title: str, score: int, grade: str, counts: dict[str, int] | None, issues: DataFrame, most: int = 30, scores: dict[str, int] | None = None, recommended: DataFrame | None = None, pages: DataFrame | None = None, summary: str = "") -> str:
    """A printable HTML page of one scan. All text is escaped.

    Sections: score and summary, scores of the categories, ``counts`` by severity (those of all ``issues`` where none are given), what is recommended with its steps, the first ``most`` issues
    from the worst, the first ``most`` pages by depth. Counts are those of all rows, the lists are bounded and ordered.
    """
    counted = counts if counts is not None else {r.severity: r.n for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    cell = lambda x: f"<td>{escape('' if x is None else str(x))}</td>"
    table = lambda head, rows: f"<h2>{escape(head)}</h2><table>{''.join('<tr>' + ''.join(map(cell, r)) + '</tr>' for r in rows)}</table>"
    tie = F.xxhash64(*[F.col(c) for c in ("severity", "title", "url")])
    worst = issues.select("severity", "title", "url").orderBy(severity_rank(F.col("severity")), "title", "url", tie).limit(most).collect()
    parts = [f"<h1>{escape(title)}</h1><p>Score {int(score)}, grade {escape(grade)}</p><p>{escape(summary)}</p>"]
    parts.append("<p>" + " ".join(f"{escape(str(k))}: {int(n)}" for k, n in sorted(counted.items(), key=lambda x: str(x[0]))) + "</p>")
    if scores:
        parts.append(table("Scores", scores.items()))
    if recommended is not None:
        rows = recommended.orderBy("rank").limit(most).select("rank", "problem", "how_to_fix", "estimated_result").collect()
        parts.append(table("Recommendations", [(r.rank, r.problem, " ".join(r.how_to_fix or []), r.estimated_result) for r in rows]))
    parts.append(table("Issues", worst))
    if pages is not None:
        parts.append(table("Pages", pages.select("url", "status_code", "title").orderBy("url").limit(most).collect()))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body>{''.join(parts)}</body></html>"
