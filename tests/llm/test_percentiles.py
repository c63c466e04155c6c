import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm.percentiles import counted, double_bits, first_histogram, key_value, ordered_key, select_ranks


def brute(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1]


def test_bits_are_those_of_the_double_and_keys_keep_the_order(spark):
    rng = np.random.default_rng(0)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 3.0, 1e300, -1e300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 4503599627370497.0, *rng.normal(size=300), *np.exp(rng.uniform(-700, 700, 300)), *(2.0**k for k in range(-60, 60)), *(np.nextafter(2.0**k, 0) for k in range(-60, 60))]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", double_bits(F.col("v")).alias("b"), ordered_key(F.col("v")).alias("k")).select("v", "b", "k", key_value(F.col("k")).alias("back")).collect()
    assert [r.b for r in rows] == [int(np.array(v + 0.0).view(np.int64)) for v in values]
    assert [r.back for r in rows] == [v + 0.0 for v in values]
    by = sorted(rows, key=lambda r: r.k)
    assert [r.v for r in by] == sorted(v for v in values)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5000, 60000))), min_size=1, max_size=60))
def test_exact_for_whole_numbers(spark, rows):
    df = spark.createDataFrame([(g, None if v is None else float(v), i % 3, "x") for i, (g, v) in enumerate(rows)], "g string, v double, day int, metric string")
    state = counted(df, ["g"], ["day"], ["v"])
    got = {(r.g, r.p): (r.value, r.n) for r in select_ranks(state, ["g"], [0.0, 0.5, 0.9, 1.0]).collect()}
    for g in {g for g, v in rows if v is not None}:
        own = [v for h, v in rows if h == g and v is not None]
        for p in (0.0, 0.5, 0.9, 1.0):
            assert got[g, p] == (brute(own, p), len(own))
    assert len(got) == 4 * len({g for g, v in rows if v is not None})


def test_states_of_separate_days_add_up_and_the_error_is_bounded(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.exp(rng.normal(5, 2, 3000)), -np.exp(rng.normal(0, 3, 1000)), [7.0] * 2000])
    df = spark.createDataFrame([(float(v), i % 5) for i, v in enumerate(values)], "v double, day int")
    whole = counted(df, [], ["day"], ["v"])
    parts = counted(df.where("day < 2"), [], ["day"], ["v"]).unionByName(counted(df.where("day >= 2"), [], ["day"], ["v"]))
    for digits in ((16, 8, 8), (16, 16, 16, 16), (12, 6)):
        a = {r.p: r.value for r in select_ranks(whole, [], [0.01, 0.5, 0.99], digits).collect()}
        assert a == {r.p: r.value for r in select_ranks(parts, [], [0.01, 0.5, 0.99], digits).collect()}
        for p, v in a.items():
            exact = brute(values, p)
            assert abs(v - exact) <= abs(exact) * 2.0 ** (12 - sum(digits)) if sum(digits) < 64 else v == exact
    assert first_histogram(whole, ["day"]).agg(F.sum("n")).first()[0] == len(values)


def test_empty_null_and_nan(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "g int, v double")
    assert select_ranks(counted(df, ["g"], [], ["v"]), ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        select_ranks(counted(df, ["g"], [], ["v"]), ["g"], [0.5], (40, 40))


def test_day_states_merge_to_the_percentiles_of_all_days(spark, tmp_path):
    from sitelens.llm import percentile_queries as Q
    from sitelens.llm import queries
    from sitelens.llm.percentiles import select_ranks

    pages = [(i, f"s{i % 2}", 100 + 37 * i % 1013, 500 + i % 91, f"2024-01-0{1 + i % 3} 10:00:00") for i in range(300)]
    spark.createDataFrame(pages, "page_id bigint, scan_id string, response_time_ms int, word_count int, at string").selectExpr("*", "cast(at as timestamp) as fetched_at", "cast(at as timestamp) as ingested_at").write.parquet(f"{tmp_path}/site_pages.parquet")
    spark.createDataFrame([("s0", "https://A.example/"), ("s1", "a.example")], "scan_id string, root_url string").selectExpr("*", "current_timestamp() as ingested_at").write.parquet(f"{tmp_path}/scans.parquet")
    days = queries.queries()["p6_day_states"](spark, str(tmp_path)).cache()
    parts = [days.where(f"day = '2024-01-0{d}'").drop("day") for d in (1, 2, 3)]
    merged = select_ranks(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["site"], Q.PROBABILITIES)
    whole = Q.p6_site_percentiles(spark, str(tmp_path))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect())) and merged.count() == 8
