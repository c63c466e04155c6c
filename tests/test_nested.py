import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.functions.jsonlite import read_json
from sitelens.operators.nested import AI_PLAN, DETAIL, flatten, typed_table, visitor, write_tables


def rows(spec, text):
    return [(r[0], r[3], r[4]) for r in visitor(spec, False)("k", text)]


PLAN = {"prioritized_recommendations": [{"title": "a", "how_to_fix": ["x", None, "y"], "code_snippet": None}, None, {"title": "b", "code_snippet": [{"code": "1"}, {"code": "2"}]}], "action_plan": {"day_30": ["p"], "day_60": [], "day_90": "q"}}
EXPECTED = [("recommendation", 0, -1), ("fix_step", 0, 0), ("fix_step", 0, 2), ("recommendation", 2, -1), ("code_snippet", 2, 0), ("code_snippet", 2, 1), ("plan_day_30", 0, -1), ("plan_day_90", 0, -1)]


def camel(value):
    if isinstance(value, dict):
        return {"".join(w.capitalize() if i else w for i, w in enumerate(k.split("_"))): camel(v) for k, v in value.items()}
    return [camel(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize(
    "text",
    [
        json.dumps(PLAN), json.dumps(PLAN, indent=2), json.dumps(json.dumps(PLAN)), json.dumps({"result": PLAN}), "```json\n" + json.dumps(PLAN) + "\n```", "Here is the plan:\n```\n" + json.dumps(PLAN) + "\n```",
        json.dumps(camel(PLAN)), "﻿" + json.dumps(PLAN), json.dumps({"data": json.dumps(PLAN)}), json.dumps([PLAN]),
    ],
)
def test_packing_wrapping_and_spelling_do_not_matter(text):
    assert rows(AI_PLAN, text) == EXPECTED


@pytest.mark.parametrize("text", ["", "null", "{}", "not json", json.dumps(PLAN)[:-1], json.dumps({"detail": {"h1s": ["a"]}})[:-1], '{"h1s": ["a", "b'])
def test_damaged_and_empty_texts_give_no_rows(text):
    assert rows(AI_PLAN, text) == [] and rows(DETAIL, text) == []


def test_bare_values_and_headers():
    detail = {"detail": {"chain": [{"url": "u", "headers": {"name": "a", "value": "b"}}, None, {"url": "v", "headers": [None, {"name": "c"}]}]}}
    assert rows(DETAIL, json.dumps(detail)) == [("hop", 0, -1), ("hop_header", 0, 0), ("hop", 2, -1), ("hop_header", 2, 1)]
    assert rows(DETAIL, '{"sampleImages": {"src": "x"}}') == [("sample_image", 0, -1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), max_size=6), st.lists(st.lists(st.text(), max_size=3), max_size=4))
def test_round_trip_of_any_lists(h1s, steps):
    found = rows(DETAIL, json.dumps({"h1s": h1s}))
    assert found == [("h1", i, -1) for i, v in enumerate(h1s) if v is not None]
    plan = {"prioritized_recommendations": [{"how_to_fix": s} for s in steps]}
    assert sum(r[0] == "fix_step" for r in rows(AI_PLAN, json.dumps(plan))) == sum(map(len, steps))


def test_deep_text_does_not_crash():
    assert read_json("[" * 100_000) is None


def test_tables_keep_links_and_clashing_columns_are_ignored(spark, tmp_path):
    df = spark.createDataFrame([("s1", json.dumps(PLAN), 1), ("s2", None, 2), (None, json.dumps(PLAN), 3)], "scan_id string, ai_plan string, tag int")
    nodes = flatten(df, "scan_id", "ai_plan", AI_PLAN).cache()
    assert nodes.count() == len(EXPECTED)
    steps, recs = typed_table(nodes, "fix_step"), typed_table(nodes, "recommendation")
    assert steps.join(recs.select(recs.node_id.alias("parent_id"), "title"), "parent_id").select("title", "value").collect() == [("a", "x"), ("a", "y")]
    write_tables(nodes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("tag = 'code_snippet'").count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "scan_id string, ai_plan string")
    assert flatten(df, "scan_id", "ai_plan", AI_PLAN).count() == 0


def test_any_depth_and_any_path():
    from sitelens.operators.nested import Child

    spec = (Child("a", ("x", "as"), (Child("b", ("inner", "bs"), (Child("c", ("cs",), (Child("d", ("d",)),)),)),)),)
    text = json.dumps({"wrap": {"deep": {"deeper": {"still": {"under": {"x": {"as": [{"n": 1, "inner": {"bs": [None, {"cs": [{"d": "p"}, {"d": ["q", None, "r"], "other": 7}]}]}}, {"n": 2}]}}}}}}})
    got = list(visitor(spec)("k", text))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [
        ("a", "k/a/0", 0, -1), ("b", "k/a/0/b/1", 0, 1), ("c", "k/a/0/b/1/c/0", 0, 0), ("d", "k/a/0/b/1/c/0/d/0", 0, 0), ("c", "k/a/0/b/1/c/1", 0, 1),
        ("d", "k/a/0/b/1/c/1/d/0", 0, 0), ("d", "k/a/0/b/1/c/1/d/2", 0, 2), ("a", "k/a/1", 1, -1),
    ]
    parents = {r[1]: r[2] for r in got}
    assert parents["k/a/0"] == "k" and all(parents[k] in parents for k in parents if k.count("/") > 2)
    assert json.loads(got[4][5]) == {"other": 7} and json.loads(got[0][5]) == {"n": 1}
    lists = json.dumps({"x": [{"as": ["p"]}, {"as": ["q", "r"]}]})  # a list on the way is gone through
    assert [(r[0], r[3]) for r in visitor(spec)("k", lists)] == [("a", 0), ("a", 1), ("a", 2)]


def test_several_plans_in_one_text_are_numbered_on():
    two = json.dumps([PLAN, {"action_plan": {"day_30": ["later"]}}, {"note": 1}])
    got = rows(AI_PLAN, two)
    assert got == [*EXPECTED, ("plan_day_30", 1, -1)]
    keys = [r[1] for r in visitor(AI_PLAN)("k", two)]
    assert len(keys) == len(set(keys))


def test_own_fields_of_the_record_and_unknown_fields_are_kept(spark):
    plan = PLAN | {"executive_summary": "good", "version": 3}
    plan["prioritized_recommendations"] = [{"title": "t", "owner": {"team": "web"}, "how_to_fix": ["x"]}]
    df = spark.createDataFrame([("s1", json.dumps(plan)), ("s2", json.dumps({"h1s": ["a"]}))], "scan_id string, ai_plan string")
    nodes = flatten(df, "scan_id", "ai_plan", AI_PLAN, root="plan")
    (own,) = typed_table(nodes, "plan").collect()
    assert (own.root_id, own.node_id, own.parent_id, own.ord, own.executive_summary, own.rest) == ("s1", "s1/plan/0", "s1", 0, "good", {"version": "3"})
    (rec,) = typed_table(nodes, "recommendation").collect()
    assert rec.title == "t" and json.loads(rec.rest["owner"]) == {"team": "web"} and set(rec.rest) == {"owner"}


def test_tables_written_by_tag_equal_a_walk_of_its_own(spark, tmp_path):
    """Brute force: a recursive walk over parsed texts against the rows read back from the tagged files."""
    from sitelens.operators.nested import read_tables

    texts = {f"s{i}": {"prioritized_recommendations": [{"title": f"t{i}{j}", "how_to_fix": [f"step {k}" for k in range(j)]} for j in range(i % 4)], "action_plan": {"day_60": [f"d{i}"] * (i % 3)}} for i in range(12)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "scan_id string, ai_plan string")
    write_tables(flatten(df, "scan_id", "ai_plan", AI_PLAN), str(tmp_path / "t"))
    got = {(r.root_id, r.tag, r.ord, r.sub_ord, json.loads(r.payload).get("title", json.loads(r.payload).get("value"))) for r in read_tables(spark, str(tmp_path / "t")).collect()}
    expected = set()
    for k, v in texts.items():
        for j, rec in enumerate(v["prioritized_recommendations"]):
            expected.add((k, "recommendation", j, -1, rec["title"]))
            expected |= {(k, "fix_step", j, n, s) for n, s in enumerate(rec["how_to_fix"])}
        expected |= {(k, "plan_day_60", n, -1, s) for n, s in enumerate(v["action_plan"]["day_60"])}
    assert got == expected
