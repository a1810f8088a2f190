"""Nested course content as JSON: checking, stripping of unknown keys, plain lines, and one row per concept.

The depth of such trees is not bounded by a schema, so these are Arrow UDFs that walk a tree with a stack, in document order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys of each kind of node with the kind of their value (a list holds the kind of its items), the keys that
#: must be there, and the keys of which one must be there.
KEYS: dict[str, dict[str, Any]] = {
    "content": {"subject": "text", "grade": "grade", "topics": ["topic"]},
    "topic": {"name": "text", "subtopics": ["subtopic"]},
    "subtopic": {"name": "text", "concepts": ["concept"], "subtopics": ["subtopic"]},
    "concept": {"name": "text", "summary": "text", "steps": ["string"], "questions": ["question"]},
    "question": {"question": "text", "acceptable_answers": ["string"], "hints": ["string"]},
}
REQUIRED = {
    "content": ("subject", "grade", "topics"), "topic": ("name", "subtopics"), "subtopic": ("name",),
    "concept": ("name", "summary", "steps", "questions"), "question": ("question", "acceptable_answers", "hints"),
}
ONE_OF = {"subtopic": ("concepts", "subtopics")}
NOT_EMPTY = {("question", "acceptable_answers")}
#: Keys whose plain values become lines, in this order, and those whose lists of texts do.
LINE_KEYS = (
    "subject", "grade", "name", "summary", "question", "answer", "acceptable_answers", "hint", "hints", "description", "example",
    "formula", "explanation",
)
LIST_KEYS = ("acceptable_answers", "hints")

CHECKED = "struct<content:string,dropped:array<string>,errors:array<string>>"
CONCEPTS = (
    "array<struct<ord:int,topic:string,path:array<string>,name:string,summary:string,steps:array<string>,"
    "questions:array<struct<question:string,answers:array<string>,hints:array<string>>>>>"
)


def _wrong(kind: str, value: Any) -> str | None:
    if kind == "grade":
        fine = (type(value) is int and 1 <= value <= 12) or (isinstance(value, str) and value.isascii() and value.isdigit() and str(int(value)) == value and 1 <= int(value) <= 12)
        return None if fine else "is no grade from 1 to 12"
    if not isinstance(value, str):
        return "is no text"
    return "is empty" if kind == "text" and not value else None


def checked(text: str | None) -> dict | None:
    """content without the keys that KEYS does not have, their paths (dropped), and what is wrong with the rest (errors)."""
    if text is None:
        return None
    try:
        root = json.loads(text)
    except (ValueError, RecursionError) as e:
        return {"content": None, "dropped": [], "errors": [f"no JSON: {e}"]}
    dropped: list[str] = []
    errors: list[str] = []
    out: list[Any] = [None]
    todo = [("content", root, "", out, 0)]  # kind, value, path, and where the clean value goes
    while todo:
        kind, value, path, into, at = todo.pop()
        if kind not in KEYS:
            into[at] = value
            if told := _wrong(kind, value):
                errors.append(f"{path} {told}")
            continue
        if not isinstance(value, dict):
            into[at] = value
            errors.append(f"{path or 'content'} is no object")
            continue
        keys, clean = KEYS[kind], {}
        into[at] = clean
        dot = f"{path}." if path else ""
        dropped += [f"{dot}{k}" for k in value if k not in keys]
        errors += [f"{dot}{k} is missing" for k in REQUIRED[kind] if k not in value]
        if (one := ONE_OF.get(kind)) and not any(k in value for k in one):
            errors.append(f"{path} has none of {', '.join(one)}")
        children = []
        for k, v in value.items():
            inner = keys.get(k)
            if inner is None:
                continue
            clean[k] = v
            if not isinstance(inner, list):
                children.append((inner, v, dot + k, clean, k))
            elif not isinstance(v, list):
                errors.append(f"{dot}{k} is no list")
            else:
                clean[k] = list(v)
                if not v and (kind, k) in NOT_EMPTY:
                    errors.append(f"{dot}{k} is empty")
                children += [(inner[0], x, f"{dot}{k}[{i}]", clean[k], i) for i, x in enumerate(v)]
        todo += reversed(children)
    return {"content": json.dumps(out[0], ensure_ascii=False), "dropped": dropped, "errors": errors}


def _nodes(root: Any) -> Iterator[dict]:
    """All objects, each before those inside it, in document order."""
    todo = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
            todo += reversed(x.values())
        elif isinstance(x, list):
            todo += reversed(x)


def lines(text: str | None) -> str | None:
    """``key: value`` lines of the keys in LINE_KEYS, node by node; items of lists under the singular key. Null if it is no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    out = []
    for node in _nodes(root):
        out += [f"{k}: {node[k]}" for k in LINE_KEYS if isinstance(node.get(k), (str, int, float))]
        out += [f"{k[:-1]}: {x}" for k in LIST_KEYS if isinstance(node.get(k), list) for x in node[k] if isinstance(x, str)]
    return "\n".join(out)


def _texts(value: Any) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def concepts(text: str | None) -> list[dict] | None:
    """The concepts of content in document order: topic, path of subtopics, and their fields. Null if it is no JSON."""
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    out: list[dict] = []
    topics = root.get("topics") if isinstance(root, dict) else None
    for topic in topics if isinstance(topics, list) else []:
        todo = [(topic, ())]
        while todo:
            node, path = todo.pop()
            if not isinstance(node, dict):
                continue
            for c in node.get("concepts") or []:
                if not isinstance(c, dict):
                    continue
                asked = [q for q in c.get("questions") or [] if isinstance(q, dict)]
                out.append({
                    "ord": len(out), "topic": topic.get("name"), "path": list(path), "name": c.get("name"), "summary": c.get("summary"),
                    "steps": _texts(c.get("steps")),
                    "questions": [{"question": q.get("question"), "answers": _texts(q.get("acceptable_answers")), "hints": _texts(q.get("hints"))} for q in asked],
                })
            inner = [s for s in node.get("subtopics") or [] if isinstance(s, dict)]
            todo += [(s, (*path, s.get("name"))) for s in reversed(inner)]
    return out


def _udf(one, kind: str):
    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    def rows(x: pd.Series) -> pd.DataFrame:
        none = {"content": None, "dropped": None, "errors": None}
        return pd.DataFrame([one(v) or none for v in x], columns=list(none))

    return F.pandas_udf(rows if kind.startswith("struct") else run, kind)


def checked_content(text: Column) -> Column:
    return _udf(checked, CHECKED)(text)


def content_lines(text: Column) -> Column:
    return _udf(lines, "string")(text)


def content_concepts(text: Column) -> Column:
    return _udf(concepts, CONCEPTS)(text)
