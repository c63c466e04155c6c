"""Shared pieces of the text operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import cut
from sitelens.tables import latest, load

#: Words are runs of letters and digits in lower case.
WORD_PATTERN = r"([\p{L}\p{N}]+)"
WORD = re.compile(r"[^\W_]+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def crawled(spark, folder: str, *columns: str) -> DataFrame:
    """The counting row of each crawled page."""
    return latest(load(spark, folder, "crawled_pages").select("page_id", *columns, "ingested_at"), "page_id").drop("ingested_at")


def documents(spark, folder: str, *columns: str, only: DataFrame | None = None) -> DataFrame:
    """The counting row of each document, or of those whose ``doc_id`` is in ``only``, which are picked before rows are told apart."""
    rows = load(spark, folder, "documents").select("doc_id", *columns, "ingested_at")
    rows = rows if only is None else rows.join(only, "doc_id", "left_semi")
    return latest(rows, "doc_id").drop("ingested_at")


def small(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, and whether it has; else as it is, for a shuffled join."""
    fits = df.limit(limit + 1).count() <= limit
    return (F.broadcast(df) if fits else df), fits


def plain_source(source: Column) -> Column:
    """One spelling for a source name: lower case, words joined by underscores; blank is null."""
    name = F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(name != "", name)


#: Rows of one key from which a join spreads it, the tasks it is spread over, and the most such keys that are broadcast.
HOT_ROWS, SPREAD, HOT_KEYS = 100_000, 64, 1_000_000


def hot_keys(counts: DataFrame, key: str, n: str, rows: int = HOT_ROWS) -> tuple[DataFrame, int]:
    """The keys of ``counts`` (one row a key) with more than ``rows`` rows ``n``, as a written table of at most ``HOT_KEYS`` rows, and their number.

    There are at most count / rows of them; where that is still too many the bar is raised, so the table can always be broadcast.
    """
    hot = cut(counts.where(F.col(n) > rows).select(F.col(key), F.col(n).alias("__n")))
    while (size := hot.count()) > HOT_KEYS:
        rows *= 2
        hot = hot.where(F.col("__n") > rows)
    return hot.select(key), size


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame | None = None, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` by shuffling, with the hot keys of ``left`` spread over tasks.

    Keys with more than ``rows`` rows of ``left`` are salted by a hash of ``by`` on the
    left and repeated for every salt on the right, which may hold many rows of a
    key too. ``counts`` (key, n) gives the rows of each key of ``left`` where they are known, else they are
    counted. Neither side is broadcast, whatever size the planner takes it for.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("n"))
    hot, size = hot_keys(counts, key, "n", HOT_ROWS if rows is None else rows)
    if not size:
        return left.join(right.hint("merge"), key, how)
    flagged = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salted = left.join(flagged, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("__hot")
    spread = right.join(flagged, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(spread.hint("merge"), [key, "__salt"], how).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, by: str, rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right`` (one row a key, ``n`` rows of ``left`` each) with hot keys spread over tasks."""
    return spread_join(left, right.drop(n), key, by, right.select(key, F.col(n).alias("n")), rows=rows)
