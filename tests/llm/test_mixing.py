import os

import pytest
from pyspark.sql import functions as F

from sitelens.llm import mixing as M
from sitelens.llm.common import plain_source

needs_tokenizer = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer files")


def test_schedule_is_even_everywhere_and_ranks_are_complete(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 97)
    shares = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    rows = M.schedule(spark, 2000, shares).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(2000))
    seen = dict.fromkeys(shares, 0)
    for r in rows:
        assert r.rank == seen[r.source]
        seen[r.source] += 1
        for s, share in shares.items():
            assert abs(seen[s] - share * (r.slot + 1)) < 6


def docs(spark, rows):
    return spark.createDataFrame(rows, "source string, doc_id bigint, tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_are_met_and_repeats_kept_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_TOKENS", 3000)
    rows = [("big", i, 10 + i % 90) for i in range(3000)] + [("mid", 5000 + i, 50) for i in range(300)] + [("small", 9000 + i, 37) for i in range(120)] + [("not listed", 1, 99), (None, 2, 99), ("big", 77777, 0)]
    table, aims = docs(spark, rows), targets(spark, [("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 3)])
    mixture = M.mix(table, aims, block=256).cache()
    uses = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat").alias("m")).collect()
    assert all(r.n == r.m <= {"big": 1, "mid": 2, "small": 3}[r.source] for r in uses) and 77777 not in {r.doc_id for r in uses}
    got = {r.source: r for r in M.shares_of(mixture, aims, table).collect()}
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert abs(got[s].actual_share - share) < 0.02 and got[s].times_used <= got[s].max_repeats
    assert max(got[s].times_used / got[s].max_repeats for s in got) > 0.85
    assert mixture.exceptAll(M.mix(table.repartition(5), aims, block=256)).count() == 0
    per_slot = mixture.groupBy("slot").agg(F.sum("tokens").alias("t"), F.countDistinct("source").alias("s")).collect()
    assert all(r.s == 1 and r.t < 256 + 100 for r in per_slot)


def test_defined_results_at_the_edges(spark):
    aims = targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert M.mix(docs(spark, [("a", 1, 10_000)]), aims).count() == 0
    assert M.mix(docs(spark, []), aims).count() == 0
    assert M.mix(docs(spark, [("a", 1, 10)]), targets(spark, [])).count() == 0
    one = M.mix(docs(spark, [("a", 1, 100_000), ("b", 2, 100_000)]), aims, block=1000)
    assert sorted(r.doc_id for r in one.collect()) == [1, 2]


@needs_tokenizer
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ä" * 1000 + " b" * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in M.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 20_000


def test_plain_source(spark):
    df = spark.createDataFrame([(s,) for s in (" Product-Page", "PRODUCT page", "product_page", " ", None)], "s string")
    assert [r[0] for r in df.select(plain_source(F.col("s"))).collect()] == ["product_page"] * 3 + [None] * 2


def test_small_and_missing_sources_do_not_empty_the_mixture(spark):
    rows = [("big", i, 250) for i in range(300)] + [("mid", 1000 + i, 250) for i in range(100)] + [("small", 2000 + i, 160) for i in range(7)]
    aims = targets(spark, [("big", 0.6, 1), ("mid", 0.34, 2), ("small", 0.06, 4)])
    got = {r.source: r for r in M.shares_of(M.mix(docs(spark, rows), aims), aims, docs(spark, rows)).collect()}
    assert all(abs(got[s].actual_share - share) < 0.01 for s, share in (("big", 0.6), ("mid", 0.34), ("small", 0.06)))
    assert 70_000 < sum(r.tokens for r in got.values()) < 80_000 and 3.9 < got["small"].times_used <= 4

    for few, used in (([], 0), ([("small", 2000, 10)], 4)):
        table = docs(spark, rows[:400] + few)
        got = {r.source: r for r in M.shares_of(M.mix(table, aims, spare=True), aims, table).collect()}
        assert got["small"].times_used == used and abs(got["big"].actual_share / got["mid"].actual_share - 0.6 / 0.34) < 0.03
        assert got["big"].times_used > 0.99 and got["big"].times_used <= 1 and got["mid"].times_used <= 2
        assert M.mix(table, aims).where("source = 'big'").count() == 0 if not few else True


def test_parts_that_fit():
    shares, repeats = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    assert M.parts_that_fit({"a": 5000, "b": 5000, "c": 5000}, shares, repeats) == {"a": 5000, "b": 3000, "c": 2000}
    assert M.parts_that_fit({"a": 5000, "b": 5000}, shares, repeats) == {} and M.parts_that_fit({"a": 5000, "b": 5000}, shares, repeats, True) == {"a": 5000, "b": 3000}
    assert M.parts_that_fit({}, shares, repeats, True) == {} == M.parts_that_fit({}, {}, {}, True)
    assert M.parts_that_fit({"a": 5000, "b": 5000, "c": 1}, shares, repeats, True) == {"a": 5000, "b": 3000, "c": 4}
    assert M.parts_that_fit({"a": 1, "b": 5000, "c": 5000}, shares, repeats, True)["b"] < 1  # half of the shares is no small rest
