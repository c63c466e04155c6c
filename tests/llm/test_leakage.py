import re

import numpy as np
import pytest

from sitelens.llm.leakage import leaks


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, run):
    out = set()
    for d, text in docs:
        w = words_of(text)
        runs = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, passage in items:
            p = words_of(passage)
            if any(tuple(p[k : k + run]) in runs for k in range(len(p) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize(("run", "shingle"), [(13, 5), (5, 5), (8, 3)])
def test_equals_brute_force(spark, run, shingle):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(60)] + ["a", "b"] * 20
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(4, 40)))) for i in range(30)]
    items += [(100, items[0][1]), (101, "a " * 40), (102, None), (103, "")]
    docs = []
    for d in range(120):
        w = list(rng.choice(vocabulary, rng.integers(0, 60)))
        if d % 2:
            p = words_of(items[rng.integers(0, 30)][1])
            start = rng.integers(0, len(p))
            w[5:5] = p[start : start + rng.integers(1, 20)]
        docs.append((d, "  ".join(w).upper() if d % 3 else ", ".join(w)))
    docs += [(500, None), (501, ""), (502, "a, " * 14), (503, "x " * 50_000 + items[0][1]), (503, "x " * 50_000 + items[0][1])]
    got = {
        tuple(r)
        for r in leaks(
            spark.createDataFrame([(*d, "h") for d in docs], "doc_id bigint, text string, h string"), spark.createDataFrame([(*i, "h") for i in items], "item_id bigint, passage string, h string"), run=run, shingle=shingle
        ).collect()
    }
    assert got == brute(docs, items, run) and len(got) > 5


def test_empty_tables_and_bad_sizes(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, passage string")
    assert leaks(docs, items).count() == 0 and leaks(docs.limit(0), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, passage string")).count() == 0
    with pytest.raises(ValueError):
        leaks(docs, items, run=3, shingle=5)


def test_large_shingle_sets_are_joined_without_broadcast(spark, monkeypatch):
    from sitelens.llm import leakage

    monkeypatch.setattr(leakage, "BROADCAST_SHINGLES", 1)
    docs, items = spark.createDataFrame([(1, "x " + "a b c d e f g h i j k l m " + "y")], "doc_id bigint, text string"), spark.createDataFrame([(7, "a b c d e f g h i j k l m n")], "item_id bigint, passage string")
    assert [tuple(r) for r in leaks(docs, items).collect()] == [(1, 7)]
