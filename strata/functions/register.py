"""The library's functions for SQL: Arrow UDFs, table functions over texts, and expressions as SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from strata.functions import latex, outline
from strata.functions.text import HAN_RUN, LATIN_WORD, UNIT, WIDE
from strata.operators import chunk

#: SQL functions by name: parameters, type and expression.
EXPRESSIONS = {
    "text_units": ("x string", "array<string>", f"array_distinct(regexp_extract_all(lower(coalesce(x, '')), '{UNIT}', 0))"),
    "text_unit_length": ("x string", "int", f"size(regexp_extract_all(lower(coalesce(x, '')), '{UNIT}', 0))"),
    "text_words": ("x string", "array<string>", f"array_distinct(regexp_extract_all(lower(coalesce(x, '')), '{LATIN_WORD}', 0))"),
    "text_han_runs": ("x string", "array<string>", f"regexp_extract_all(coalesce(x, ''), '{HAN_RUN}', 0)"),
    "estimate_tokens": (
        "x string", "int",
        f"cast(floor((length(coalesce(x, '')) - length(regexp_replace(coalesce(x, ''), '{WIDE}', ''))) + length(regexp_replace(coalesce(x, ''), '{WIDE}', '')) * 0.30D + 0.5) as int)",
    ),
    "squeezed_hash": ("x string", "string", "sha2(regexp_replace(coalesce(x, ''), '(?U)[\\\\s\u3000]+', ''), 256)"),
}


@F.pandas_udf(StringType())
def _strip_latex(text: pd.Series) -> pd.Series:
    return text.map(latex.plain, na_action="ignore")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return latex._ratio(a, b)


@F.pandas_udf(StringType())
def _content_lines(text: pd.Series) -> pd.Series:
    return text.map(outline.lines, na_action="ignore")


class Parents:
    """parents_of(text): parent, title, chapter, content_type, start, text."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((i, *p) for i, p in enumerate(chunk.grouped(text or "")))


class Pieces:
    """pieces_of(text): piece, start, stop, text; overlapping, at sentence ends, never inside formulas or code."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from ((i, a, b, text[a:b]) for i, (a, b) in enumerate(chunk.pieces(text or "")))


class Sentences:
    """sentences_of(text): sentence, start, text."""

    def eval(self, text: str) -> Iterator[tuple]:
        x = text or ""
        cuts = [0, *[e for e in chunk.sentence_ends(x) if 0 < e < len(x)], len(x)]
        yield from ((i, a, x[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if x[a:b].strip())


TABLES = {
    "parents_of": (Parents, "parent int, title string, chapter string, content_type string, start int, text string"),
    "pieces_of": (Pieces, "piece int, start int, stop int, text string"),
    "sentences_of": (Sentences, "sentence int, start int, text string"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to a session's SQL; gives their names."""
    scalars = {"strip_latex": _strip_latex, "similarity": _ratio, "content_lines": _content_lines}
    for name, f in scalars.items():
        spark.udf.register(name, f)
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
    for name, (given, kind, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}({given}) returns {kind} return {body}")
    return [*scalars, *TABLES, *EXPRESSIONS]
