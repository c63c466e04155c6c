"""Evaluation passages inside training text: a prefix-filtered set join.

A document gives an item away if it holds at least ``run`` consecutive words
of its passage. Each window of ``run`` passage words is a set of
``run - shingle + 1`` shingles, all of which a leaking document must hold, so
one shingle is prefix enough: the rarest of the window, by its number of
documents in the whole corpus. Documents are joined on these prefix shingles
only, position and length bounds drop what cannot line up, and the window's
words are compared with the document's at the end, so hash collisions cannot
make a case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import small, words
from sitelens.session import cut

RUN = 13
SHINGLE = 5
#: Most passage shingles that are broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_SHINGLES = 500_000
#: Most windows (each of ``run`` words, some 200 bytes) that are broadcast.
BROADCAST_WINDOWS = 100_000


def _shingles(tokens: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty for a shorter text."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.size(tokens) - F.lit(size - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, size))), F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", run: int = RUN, shingle: int = SHINGLE, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Distinct rows (doc, item) of documents with ``run`` or more consecutive passage words.

    Null and empty texts or passages, and those of fewer than ``run`` words,
    give no row; items with equal passages are all listed; repeated rows count
    once; other columns are ignored. Whole texts are searched.

    The documents are read once in full; for the comparison of words those with a window in line are read
    again by ``again``, which gives the rows (doc, text) of the documents in a frame of ids (column ``doc``). Give one that
    filters before it tells rows apart, so that the others are not shuffled again.
    """
    if not 1 <= shingle <= run:
        raise ValueError("shingle must lie between 1 and run")
    listed = items.select(F.col(item).alias("item"), words(F.col(passage)).alias("p_words")).where(F.size("p_words") >= run)
    listed = listed.withColumn("passage_id", F.xxhash64("p_words", F.size("p_words")))
    passages = listed.groupBy("passage_id").agg(F.first("p_words").alias("p_words"))
    windows = cut(passages.select("passage_id", "p_words", F.explode(F.sequence(F.lit(0), F.size("p_words") - run)).alias("start")).select("passage_id", "start", F.slice("p_words", F.col("start") + 1, run).alias("w_words")))
    parts = windows.select("passage_id", "start", F.posexplode(_shingles(F.col("w_words"), shingle)).alias("offset", "h"))
    known, _ = small(parts.select("h").distinct(), BROADCAST_SHINGLES)

    tokens = docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("d_words")).where(F.size("d_words") >= run)
    spread = tokens.select("doc", F.posexplode(_shingles(F.col("d_words"), shingle)).alias("at", "h"))
    hits = cut(spread.join(known, "h"))

    rarity = hits.groupBy("h").agg(F.countDistinct("doc").alias("n_docs"))
    prefix = parts.join(rarity, "h").groupBy("passage_id", "start").agg(F.count("*").alias("found"), F.min(F.struct("n_docs", "h", "offset")).alias("rarest"))
    prefix = cut(prefix.where(F.col("found") == run - shingle + 1).select("passage_id", "start", "rarest.h", "rarest.offset"))
    # A passage may leak into a third of all documents: the item side of each join is broadcast while it is small.
    prefix, _ = small(prefix, BROADCAST_SHINGLES)
    lined_up = cut(hits.join(prefix, "h").where("at >= offset").select("doc", "passage_id", "start", (F.col("at") - F.col("offset")).alias("d_start")).distinct())
    hit, _ = small(cut(lined_up.select(F.col("doc").alias(doc)).distinct()), BROADCAST_SHINGLES)
    found = again(hit) if again is not None else docs.join(hit, doc, "left_semi")
    tokens = found.select(F.col(doc).alias("doc"), words(F.col(text)).alias("d_words"))

    all_windows, _ = small(windows, BROADCAST_WINDOWS)
    checked = lined_up.join(all_windows, ["passage_id", "start"]).join(tokens, "doc").where(F.size("d_words") >= F.col("d_start") + run)
    proven = checked.where(F.slice("d_words", F.col("d_start") + 1, run) == F.col("w_words")).select("doc", "passage_id").distinct()
    names, _ = small(cut(listed.select("passage_id", "item")), BROADCAST_SHINGLES)
    return proven.join(names, "passage_id").select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()
