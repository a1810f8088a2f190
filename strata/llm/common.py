"""What the operators share: word patterns, tables in the shared folder, and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.lookup import look_up
from strata.sources.shared import materialise

#: Fixed patterns of the contracts: white space between words, and a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["look_up", "materialise"]

#: Rows and bytes of text that a Python worker turns into objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs[column], F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(
    batches: Iterator[pa.RecordBatch], heavy: int, most_rows: int = SLICE_ROWS, most_bytes: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most most_rows rows and about most_bytes in column number heavy.

    A single longer text is a piece of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(heavy)), 0).to_pylist()
        start, size = 0, 0
        for i in range(n):
            if i > start and (i - start >= most_rows or size + lengths[i] > most_bytes):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += lengths[i]
        yield batch.slice(start, n - start)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a transform over one element binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _fold(values: Column, join=_plus) -> Column:
    """A struct of the sum s of an array of longs and its inclusive prefix sums a; join may be another operation from 0 on."""
    return F.aggregate(
        values,
        F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a")),
        lambda acc, x: F.struct(join(acc.s, x).alias("s"), F.concat(acc.a, F.array(join(acc.s, x))).alias("a")),
    )


def running_sums(values: Column, block: int = 512, join=_plus) -> Column:
    """Inclusive prefix sums of an array of longs, by blocks: near-linear, with built-in functions only."""

    def by_blocks(values: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        blocks = F.transform(places, lambda b: _fold(F.slice(values, b * block + 1, block), join))
        return let(blocks, lambda bs: let(_fold(F.transform(bs, lambda b: b.s), join).a, lambda ends: F.flatten(
            F.transform(bs, lambda b, i: let(
                F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long")),
                lambda base: F.transform(b.a, lambda v: join(base, v)),
            ))
        )))

    return let(
        values,
        lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>"))
        .when(F.size(v) <= block, _fold(v, join).a)
        .otherwise(by_blocks(v)),
    )


def running_maxima(values: Column) -> Column:
    """Inclusive prefix maxima of an array of longs of at least 0."""
    return running_sums(values, join=F.greatest)
