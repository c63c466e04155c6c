"""Deeply nested records to related flat tables, in a single pass.

A depth-first visitor walks each record once and emits one tagged row for each
child object or value at any depth, and one for the record itself: the tag names the table, ``node_id`` is its primary key,
``parent_id`` the key of the row it hangs from and ``payload`` its own fields
as JSON. :func:`write_tables` partitions the rows by tag; :func:`typed_table`
applies a tag's schema and keeps the fields that no schema knows. The plan has one Python stage and no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.jsonlite import as_list, find_objects, plain_name, read_json


@dataclass(frozen=True)
class Child:
    """One repeated child: its tag, the names that lead to it, and its own children."""

    tag: str
    path: tuple[str, ...]
    children: tuple[Child, ...] = ()


#: Fields of an AI plan and of an issue's detail, and the table each goes to.
AI_PLAN = (
    Child("recommendation", ("prioritized_recommendations",), (Child("fix_step", ("how_to_fix",)), Child("code_snippet", ("code_snippet",)))),
    Child("plan_day_30", ("action_plan", "day_30")),
    Child("plan_day_60", ("action_plan", "day_60")),
    Child("plan_day_90", ("action_plan", "day_90")),
)
DETAIL = (
    Child("shared_url", ("sharedUrls",)),
    Child("duplicate_url", ("duplicateUrls",)),
    Child("h1", ("h1s",)),
    Child("sample_image", ("sampleImages",)),
    Child("sample_target", ("sampleTargets",)),
    Child("sample_resource", ("sampleResources",)),
    Child("hop", ("chain",), (Child("hop_header", ("headers",)),)),
)

#: The schema of each table's payload; a bare value is held in ``value``.
PAYLOADS = {
    "plan": "executive_summary string, platform string",
    "issue_detail": "title string, length string, count string",
    "recommendation": "title string, problem string, why_it_matters string, action string, priority string, impact string, effort string, estimated_result string, issue_code string, affected_page_count string",
    "fix_step": "value string",
    "code_snippet": "value string, language string, filename string, code string",
    "plan_day_30": "value string",
    "plan_day_60": "value string",
    "plan_day_90": "value string",
    "shared_url": "value string",
    "duplicate_url": "value string",
    "h1": "value string",
    "sample_image": "value string, src string, width int",
    "sample_target": "value string",
    "sample_resource": "value string, src string, tag string, attrs map<string,string>",
    "hop": "value string, url string, status int",
    "hop_header": "value string, name string",
}

_NODE = pa.schema([("root_id", pa.string()), ("tag", pa.string()), ("node_id", pa.string()), ("parent_id", pa.string()), ("ord", pa.int32()), ("sub_ord", pa.int32()), ("payload", pa.string())])
NODE_DDL = "root_id string, tag string, node_id string, parent_id string, ord int, sub_ord int, payload string"


def _compiled(children: Iterable[Child], names: dict[str, str]) -> tuple:
    return tuple((c.tag, tuple(plain_name(p) for p in c.path), _compiled(c.children, names)) for c in children)


def _field(obj, name: str):
    """The value of the field that has this plain name; of several spellings the first that is not null."""
    for key, value in obj.items():
        if value is not None and plain_name(key) == name:
            return value
    return None


def _payload(item, skip: set[str], snake: dict[str, str]) -> str:
    if not isinstance(item, dict):
        return json.dumps({"value": item if isinstance(item, str) else json.dumps(item)}, ensure_ascii=False)
    return json.dumps({snake.get(n, k): v for k, v in item.items() if (n := plain_name(k)) not in skip}, ensure_ascii=False)


def _reach(node, path: tuple[str, ...]) -> list:
    """The elements at the end of a path of names; a list on the way is gone through element by element."""
    nodes = [node]
    for name in path:
        inside = []
        for n in nodes:
            n = read_json(n) if isinstance(n, str) else n
            inside += [v for d in (n if isinstance(n, list) else [n]) if isinstance(d, dict) and (v := _field(d, name)) is not None]
        nodes = inside
    return [x for v in nodes for x in as_list(v)]


def visitor(spec: tuple[Child, ...], payload: bool = True, root: str | None = None) -> Callable[[str, str], Iterator[tuple]]:
    """A function (root id, text) -> rows (tag, node_id, parent_id, ord, sub_ord, payload) in depth-first order.

    ``ord`` is the position in the outermost list, ``sub_ord`` that inside the
    parent child, -1 for the outermost. A text of several records numbers their children on. ``root`` names the
    table of the records' own fields; without it they give no row.
    """
    compiled = _compiled(spec, {})
    roots = {path[0] for _, path, _ in compiled}
    snake = {plain_name(f.split()[0]): f.split()[0] for ddl in PAYLOADS.values() for f in ddl.split(", ")}
    inner_names: dict[int, set[str]] = {}

    def fields(item, children: tuple) -> str | None:
        if not payload:
            return None
        if (skip := inner_names.get(id(children))) is None:
            skip = inner_names[id(children)] = {path[0] for _, path, _ in children}
        return _payload(item, skip, snake)

    def walk(item, children: tuple, key: str, outermost: int | None, start: list[int]) -> Iterator[tuple]:
        for c, (tag, path, inner) in enumerate(children):
            first = start[c] if start else 0
            elements = _reach(item, path)
            for i, element in enumerate(elements, first):
                if element is None:
                    continue
                if isinstance(element, str) and inner and element[:1] == "{":
                    element = read_json(element) or element
                own = f"{key}/{tag}/{i}"
                yield tag, own, key, i if outermost is None else outermost, -1 if outermost is None else i, fields(element, inner)
                if inner and isinstance(element, dict):
                    yield from walk(element, inner, own, i if outermost is None else outermost, [])
            if start:
                start[c] += len(elements)

    def visit(root_id: str, text: str) -> Iterator[tuple]:
        start = [0] * len(compiled)
        for k, value in enumerate(find_objects(read_json(text), roots)):
            if root is not None:
                yield root, f"{root_id}/{root}/{k}", root_id, k, -1, fields(value, compiled)
            yield from walk(value, compiled, root_id, None, start)

    return visit


def flatten(df: DataFrame, key: str, text: str | Column, spec: tuple[Child, ...], payload: bool = True, root: str | None = None) -> DataFrame:
    """Tagged rows of every child in ``text`` of every row of ``df``.

    ``key`` must be unique (see :func:`sitelens.tables.latest`). Null, empty
    and damaged texts, and rows with a null key, give no rows; a null element
    keeps its position but is no row; other columns of ``df`` play no part,
    whatever their names. A text may be of any length. An empty table gives an
    empty result of the same schema.
    """
    text = F.col(text) if isinstance(text, str) else text
    narrow = df.select(F.col(key).cast("string").alias("k"), text.alias("t")).where("k is not null and length(t) > 6")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit = visitor(spec, payload, root)
        for batch in batches:
            out: list[list] = [[] for _ in _NODE]
            for root_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in visit(root_id, body):
                    out[0].append(root_id)
                    for column, cell in zip(out[1:], row):
                        column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _NODE)], schema=_NODE)

    return narrow.mapInArrow(run, NODE_DDL)


def typed_table(nodes: DataFrame, tag: str, schema: str | None = None) -> DataFrame:
    """One flat table: keys, positions, the payload's fields under the tag's schema, and in ``rest`` (name to JSON text) the fields that it lacks."""
    schema = schema or PAYLOADS[tag]
    names = [f.split()[0] for f in schema.split(", ")]
    # a map's own commas are no field separators
    names = [n for n in names if "<" not in n and ">" not in n]
    rest = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: ~k.isin(names))
    return (
        nodes.where(F.col("tag") == tag)
        .withColumns({"p": F.from_json("payload", schema), "rest": rest})
        .select("root_id", "node_id", "parent_id", "ord", "sub_ord", *[F.col("p")[n].alias(n) for n in names], "rest")
    )


def write_tables(nodes: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """All tables in one write, a sub-folder for each tag."""
    nodes.write.mode(mode).partitionBy("tag").parquet(folder)


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tagged rows of :func:`write_tables`; a filter on ``tag`` reads that table's files alone."""
    return spark.read.schema(NODE_DDL).parquet(folder)
