"""Rule tables from YAML files: synonyms and book rules. Files of at most MOST bytes, read by Spark and parsed on the driver."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strata.operators.route import DECORATION

try:
    import yaml
except ModuleNotFoundError:
    yaml = None

MOST = 1 << 20


def parsed(spark: SparkSession, path: str) -> dict[str, Any]:
    """The mapping in a YAML file; empty for an empty file. Raises without the parser, for a larger file and for another shape."""
    if yaml is None:
        raise ModuleNotFoundError("a YAML parser is needed to read rule files")
    size = spark.read.format("binaryFile").load(path).selectExpr("sum(length) as n").first()["n"] or 0
    if size > MOST:
        raise ValueError(f"{path} has more than {MOST} bytes")
    row = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(row["value"] if row else "") or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """term, synonym, ord from ``groups`` of ``terms``: all terms of a group stand for each other; groups of one term go.

    ord counts a term's synonyms over all groups in file order; repeated ones are one.
    """
    known: dict[str, dict[str, int]] = {}
    for group in parsed(spark, path).get("groups") or []:
        terms = list(dict.fromkeys(t for t in (str(x).strip() for x in group.get("terms") or []) if t))
        for term in terms if len(terms) > 1 else []:
            own = known.setdefault(term, {})
            for other in terms:
                if other != term:
                    own.setdefault(other, len(own))
    return spark.createDataFrame([(t, s, i) for t, own in known.items() for s, i in own.items()], "term string, synonym string, ord int")


def books(spark: SparkSession, path: str) -> DataFrame:
    """book_id, rule_order, match_all, exclude, subject, grade, grade_span from ``books``, as match_books takes them.

    Alternatives and vetoes are lowered and freed of decoration, as names are before they are matched.
    """
    plain = lambda x: re.sub(DECORATION, "", str(x)).lower()
    text = lambda x: None if x is None else str(x)
    rows = [
        (
            text(b.get("book_id", b.get("id"))), i, [[plain(a) for a in group] for group in b.get("match_all") or []], [plain(x) for x in b.get("exclude") or []],
            text(b.get("subject")), text(b.get("grade")), [str(g) for g in b.get("grade_span") or []],
        )
        for i, b in enumerate(parsed(spark, path).get("books") or [])
    ]
    kind = "book_id string, rule_order int, match_all array<array<string>>, exclude array<string>, subject string, grade string, grade_span array<string>"
    return spark.createDataFrame(rows, kind)
