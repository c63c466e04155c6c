"""Queries with SQL equal DuckDB on the smallest tables; the others equal brute force or what they must keep."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from sitelens.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(df):
    return Counter(tuple(round(float(x), 9) if isinstance(x, (int, float)) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, expected = queries.queries()[name](spark, FOLDER).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)


@pytest.fixture(scope="module")
def got(spark):
    """Rows of the queries that SQL can not express, over the whole smallest tables."""
    import functools

    @functools.cache
    def run(name):
        return queries.queries()[name](spark, FOLDER).toPandas()

    return run


@pytest.fixture(scope="module")
def pages():
    """(text, title) of each page's counting row."""
    sql = f"select page_id, body_text, title from '{FOLDER}/crawled_pages.parquet' qualify row_number() over (partition by page_id order by ingested_at desc) = 1"
    return {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}


def test_every_query_without_sql_is_compared_here():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"p2_found", "p2_groups", "p3_found", "p3_content", "p4_found", "p4_kinds", "p5_found", "p5_grades", "p8_mixture", "p8_shares", "p9_found", "p9_composition"}


def runs_of(text, n, short):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words or len(words) < n and not short:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similar(pages, excluded, n, threshold, strict, short):
    sets = {k: s for k, (text, _) in pages.items() if k not in excluded and (s := runs_of(text, n, short))}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return {(a, b) for a in sets for b in sets if a < b and ((s := share(a, b)) > threshold or not strict and s == threshold)}, sets


def test_pairs_and_groups_equal_all_pairs_compared(got, pages):
    excluded = set(got("p4_found").page_id)
    expected, _ = similar(pages, excluded, 3, 0.55, True, False)
    assert {tuple(r) for r in got("p2_found").itertuples(index=False)} == expected and expected
    links, sets = similar(pages, excluded, 5, 0.8, False, True)
    root = {k: k for k in sets}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert {r.page_id: r.group_id for r in got("p2_groups").itertuples()} == {k: top(k) for k in sets}


def test_content_and_furniture_make_up_the_page(got, pages):
    excluded = set(got("p4_found").page_id)
    furniture = {}
    for r in got("p3_found").itertuples():
        furniture.setdefault(r.page_id, set()).add(r.line_no)
    content = {r.page_id: r for r in got("p3_content").itertuples()}
    assert set(content) == {k for k, (text, _) in pages.items() if text and k not in excluded}
    for k, r in content.items():
        lines = pages[k][0].split("\n")
        if len(lines) > 1:
            own = [x for i, x in enumerate(lines, 1) if i not in furniture.get(k, ()) and x.strip()]
            assert r.content == "\n".join(own) and max(furniture.get(k, {1})) <= len(lines)
        assert r.word_count == len(re.findall(r"[^\W_]+", r.content.lower()))
    kinds = got("p4_kinds")
    assert set(kinds.page_id) == excluded and set(kinds.kind) <= {"mark", "filler", "notice"} and len(kinds) == len(excluded)


def test_bands_are_those_of_the_grades(got):
    from sitelens.llm import reading

    grades = got("p5_grades")
    assert list(grades.band) == [reading.band(g) for g in grades.grade] and set(zip(grades.page_id, grades.band)) == {tuple(r) for r in got("p5_found").itertuples(index=False)}
    words = {r.page_id: r.word_count for r in got("p3_content").itertuples()}
    assert len(grades) and all(words[k] >= 60 for k in grades.page_id)


def test_mixture_keeps_repeats_and_reports_its_shares(got):
    mixture, shares = got("p8_mixture"), got("p8_shares").set_index("source")
    used = mixture.groupby("source").tokens.sum()
    assert len(mixture) and abs(shares.actual_share.sum() - 1) < 1e-9
    for source, r in shares.iterrows():
        assert r.tokens == used.get(source, 0) and abs(r.actual_share - r.tokens / used.sum()) < 1e-9 and r.times_used <= r.max_repeats
    assert mixture.groupby(["source", "doc_id"])["repeat"].nunique().max() <= shares.max_repeats.max() and not mixture.duplicated(["doc_id", "repeat"]).any()


def test_composition_counts_the_subjects_found(got):
    found, composition = got("p9_found"), got("p9_composition").set_index("subject").n_docs
    n = duckdb.sql(f"select count(distinct doc_id) from '{FOLDER}/documents.parquet'").fetchall()[0][0]
    per = found.groupby("doc_id").size()
    assert (per <= 2).all() and not found.duplicated().any() and composition.get("", 0) == n - len(per)
    assert composition.drop("", errors="ignore").to_dict() == found.groupby("subject").size().to_dict()
