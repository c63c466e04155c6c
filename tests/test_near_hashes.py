"""Near hashes: layouts by size, and no side that grows is broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import duplicates


def close(rng, n, flips=4):
    """Hashes of which every third differs from an earlier one in a few bits."""
    out = []
    for k in range(n):
        value = int(rng.integers(0, 2**63)) if k % 3 or not out else out[int(rng.integers(0, len(out)))]
        for f in rng.choice(64, int(rng.integers(1, flips + 1)), replace=False) if k % 3 == 0 else ():
            value ^= 1 << int(f)
        out.append(value)
    return [v - 2**64 if v >= 2**63 else v for v in out]


def brute(rows, distance):
    out = []
    for g in {r[0] for r in rows}:
        hashes = sorted({h for s, h in rows if s == g})
        apart = ((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(hashes) for b in hashes[i + 1 :])
        out += [(g, *x) for x in apart if x[2] <= distance]
    return sorted(out)


@pytest.mark.parametrize("distance", [3, 6])
def test_groups_of_any_size_equal_brute_force(spark, monkeypatch, distance):
    rng = np.random.default_rng(distance)
    monkeypatch.setattr(duplicates, "LOOK", 0.5)  # so that small groups take several layouts
    rows = [(f"s{g}", h) for g, n in enumerate((1, 5, 90, 700)) for h in close(rng, n)]
    assert len({sum(n >= least for least, _ in duplicates.layouts(distance)) for n in (5, 90, 700)}) > 1
    df = spark.createDataFrame([*rows, ("s1", None), (None, 5), (None, 6)], "scan_id string, simhash bigint")
    got = sorted(tuple(r) for r in duplicates.near_hashes(df, ["scan_id"], "simhash", distance).collect())
    assert got == brute(rows, distance) and len(got) > 100
    whole = [("", h) for _, h in rows]
    got = sorted(tuple(r) for r in duplicates.near_hashes(df.where("scan_id is not null"), (), "simhash", distance).collect())
    assert got == [r[1:] for r in brute(whole, distance)]


def test_few_rows_a_hash(spark):
    """A hundred thousand hashes take a row for each of 15 masks, not of 495, and a million no more than 15."""
    for n in (100_000, 1_000_000):
        assert len(next(masks for least, masks in reversed(duplicates.layouts(4)) if n >= least)) <= 15


def test_exploded_hashes_are_not_broadcast(spark):
    """The planner takes the keys for as small as the hashes; broadcast, they filled the driver."""
    df = spark.range(2000).select(F.lit("s").alias("scan_id"), F.col("id").alias("page_id"), F.col("id").alias("page_ord"), F.lit("u").alias("url"), F.concat(F.lit("stone river cloud brook meadow "), F.repeat(F.concat(F.lit(" tree"), F.col("id")), 9)).alias("body_text"))
    for frame in (duplicates.near_pairs(df, ["scan_id"], 6), duplicates.near_hashes(df.select(F.xxhash64("page_id").alias("simhash")), (), "simhash", 4)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_the_rule_broadcasts_no_hashes(spark, make_pages):
    from sitelens.operators.site_rules import near_duplicate_content

    text = " ".join(f"stone{i} river{i * 7} cloud{i * 3}" for i in range(60))
    found = near_duplicate_content(make_pages({"body_text": text}, {"body_text": text + " brook1"}))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.page_id for r in found.collect()] == [1]


def test_no_rule_over_several_pages_broadcasts_a_side(spark):
    """Links, URLs and stored pages grow with the crawl; the planner takes the sides of their joins for small."""
    from sitelens.plans.audit_queries import found_issues

    plan = found_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
