"""Exact and near duplicates by content hash and 64-bit SimHash."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.text import bits_apart, content_hash, simhash
from sitelens.session import cut

#: Shorter texts are not compared.
LEAST_CHARS = 50
#: What it costs to compare a pair of hashes that share a key, against what a row of a key costs.
LOOK = 0.05


def exact_members(pages: DataFrame, within: Sequence[str] = (), text: str = "body_text", key: str = "page_id", label: str = "url", order: str = "page_ord") -> DataFrame:
    """(within, content_hash, key, label, order, n): every row of a group of two or more equal texts, with the group's size.

    Texts that are null or shorter than 50 characters are left out. Groups are
    counted by their hash; texts are not shuffled and no group is listed.
    """
    rows = pages.where(F.length(text) >= LEAST_CHARS).select(*within, *dict.fromkeys([order, key, label]), content_hash(F.col(text)).alias("content_hash"))
    many = rows.groupBy(*within, "content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(many.hint("merge"), [*within, "content_hash"])


def exact_groups(pages: DataFrame, within: Sequence[str] = (), text: str = "body_text", key: str = "page_id", order: str = "page_ord") -> DataFrame:
    """(within, content_hash, n, first): the groups of equal texts, their sizes and the key of the first row of each."""
    rows = pages.where(F.length(text) >= LEAST_CHARS).select(*within, *dict.fromkeys([order, key]), content_hash(F.col(text)).alias("content_hash"))
    return rows.groupBy(*within, "content_hash").agg(F.count("*").alias("n"), F.min(F.struct(*dict.fromkeys([order, key])))[key].alias("first")).where("n > 1")


def band_masks(distance: int, blocks: int) -> list[int]:
    """Masks of a 64-bit value so that two values at most ``distance`` bits apart agree under one of them.

    The bits are cut into ``blocks`` blocks; the differing bits touch at most
    ``distance`` of them, so some choice of the other blocks is equal. More
    blocks mean longer keys, hence fewer chance meetings, and more masks.
    """
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def layouts(distance: int, most: int = 5) -> list[tuple[int, list[int]]]:
    """(least n, masks), by size: the masks that pair n different hashes at least cost, the fewest for few hashes.

    With k of ``distance`` + k blocks kept a mask leaves 64 k / (distance + k) bits; a hash costs a row for each
    mask and a look at what shares its key, of which real texts have some five times as many as chance. k = 0 is
    the one mask under which all are compared.
    """
    out: list[tuple[int, list[int]]] = [(0, [0])]
    fixed, each = 1.0, LOOK
    for k in range(1, most + 1):
        masks = band_masks(distance, distance + k)
        cost, slope = float(len(masks)), len(masks) * 5 * LOOK / 2 ** (64 * k / (distance + k))
        out.append((int((cost - fixed) / (each - slope)) + 1, masks))
        fixed, each = cost, slope
    return out


def near_hashes(values: DataFrame, within: Sequence[str], value: str = "simhash", distance: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs (within, h_a, h_b, distance) of different hashes at most ``distance`` bits apart, h_a < h_b; exact.

    Only distinct hashes are paired: equal ones, however many, are one row. Each group of ``within`` is laid out by its
    own number of hashes (see :func:`layouts`) unless ``blocks`` is given. The planner takes the exploded
    keys for as small as the hashes, so the join forbids it to broadcast them.
    """
    hashes = cut(values.select(*within, F.col(value).alias("h")).distinct())
    array = lambda masks: F.array(*[F.lit(m).cast("bigint") for m in masks])
    if blocks:
        chosen = array(band_masks(distance, blocks))
    elif not within:
        n = hashes.count()
        chosen = array(next(masks for least, masks in reversed(layouts(distance)) if n >= least))
    else:
        first, *others = layouts(distance)
        sizes = hashes.groupBy(*within).agg(F.count("*").alias("__n")).where(F.col("__n") >= others[0][0])
        hashes = hashes.join(sizes.hint("merge"), list(within), "left")
        chosen = array(first[1])
        for least, masks in others:
            chosen = F.when(F.col("__n") >= least, array(masks)).otherwise(chosen)
    keyed = hashes.select(*within, "h", F.explode(chosen).alias("m")).withColumn("k", F.col("h").bitwiseAND(F.col("m")))
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.m") == F.col("b.m"))
    for c in within:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    apart = bits_apart(F.col("a.h"), F.col("b.h"))
    met = a.join(b.hint("merge"), on & (F.col("a.h") < F.col("b.h")) & (apart <= distance))
    return met.select(*[F.col(f"a.{c}").alias(c) for c in within], F.col("a.h").alias("h_a"), F.col("b.h").alias("h_b"), apart.alias("distance")).distinct()


def near_pairs(pages: DataFrame, within: Sequence[str] = (), distance: int = 3, text: str = "body_text", key: str = "page_id", label: str = "url", order: str = "page_ord", first: int | None = None) -> DataFrame:
    """(within, id_a, id_b, url_a, url_b, ord_a, ord_b, distance, similarity) of near-duplicate texts, the earlier first.

    Distance 0 is not reported (see :func:`exact_groups`). Similarity is the
    share of equal bits in whole per cent. With ``first`` only pairs of the first so many rows of each hash are
    given: they hold the first ``first`` - 1 pairs of each ``within`` by order, as a later row of a hash can be
    put for none of its earlier ones without coming after all their pairs. Without it two large groups of copies meet in all their pairs.
    """
    rows = cut(pages.where(F.length(text) >= LEAST_CHARS).select(*within, key, label, order, simhash(F.col(text)).alias("simhash")))
    pairs = near_hashes(rows, within, "simhash", distance)
    if first is not None:
        rank = F.row_number().over(Window.partitionBy(*within, "simhash").orderBy(order, key))
        rows = rows.withColumn("__r", rank).where(F.col("__r") <= first).drop("__r")
    side = lambda s: rows.select(*within, F.col("simhash").alias(f"h_{s}"), F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(label).alias("l")).alias(s))
    # by its files the planner takes a side of repeated URLs for far smaller than it is: none is broadcast
    met = pairs.join(side("a").hint("merge"), [*within, "h_a"]).join(side("b").hint("merge"), [*within, "h_b"])
    first, last = F.least("a", "b"), F.greatest("a", "b")
    return met.select(
        *within, first["k"].alias("id_a"), last["k"].alias("id_b"), first["l"].alias("url_a"), last["l"].alias("url_b"), first["o"].alias("ord_a"), last["o"].alias("ord_b"),
        "distance", F.floor((64 - F.col("distance")) / 64 * 100 + 0.5).cast("int").alias("similarity"),
    )
