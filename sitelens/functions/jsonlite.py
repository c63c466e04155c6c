"""Tolerant reading of JSON that was packed, fenced, wrapped or damaged on its way."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_END = object()
_DECODER = json.JSONDecoder(strict=False)
_FENCE = re.compile(r"```[a-zA-Z]*\s*")
_NOT_ALNUM = re.compile(r"[^0-9a-z]+")


def plain_name(name: str) -> str:
    """A field name without case and separators: how_to_fix and howToFix agree."""
    return _NOT_ALNUM.sub("", name.lower())


def read_json(text: str | None):
    """The first complete JSON object or list of ``text``, else None.

    Text before it (a greeting, a code fence, a byte-order mark) and after it is
    skipped. A JSON string that itself holds JSON is unpacked. Text whose
    value is cut off gives None; parts of a damaged value are never taken
    for the value.
    """
    for _ in range(5):
        if not text:
            return None
        text = text.lstrip("\ufeff \t\r\n")
        start = 0
        if text[:1] not in '{["':
            fence = _FENCE.search(text)
            start = fence.end() if fence else 0
            while start < len(text) and text[start] not in "{[":
                start += 1
        if start >= len(text):
            return None
        try:
            value, _ = _DECODER.raw_decode(text, start)
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, str):
            return value if isinstance(value, (dict, list)) else None
        text = value
    return None


def as_list(value) -> list:
    """A bare value is a list of one, a missing one an empty list; a packed list is unpacked."""
    if isinstance(value, str) and value[:1] in "[{":
        packed = read_json(value)
        value = value if packed is None else packed
    return [] if value is None else value if isinstance(value, list) else [value]


def find_objects(value, names: set[str]) -> list[dict]:
    """The outermost objects that have one of ``names`` (plain names), looking through wrappers however deep.

    Of a list all such objects are taken, in order; of an object's fields those of the first that leads to any.
    """
    todo: list[Iterator] = [iter([value])]
    fields = [False]  # whether the values of a level are an object's fields, of which the first that leads somewhere is enough
    before = [0]
    found: list[dict] = []
    while todo:
        node = next(todo[-1], _END) if not fields[-1] or len(found) == before[-1] else _END
        if node is _END:
            todo.pop(), fields.pop(), before.pop()
            continue
        if isinstance(node, str):
            node = read_json(node) if node.lstrip()[:1] in ("{", "[", '"', "`") else None
        if isinstance(node, dict) and any(plain_name(k) in names for k in node):
            found.append(node)
        elif isinstance(node, (dict, list)):
            todo.append(iter(node if isinstance(node, list) else node.values()))
            fields.append(isinstance(node, dict))
            before.append(len(found))
    return found
