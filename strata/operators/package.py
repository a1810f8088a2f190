"""Content-addressed packages: chunks by hash, caps, catalogues, validation, and what a sync still lacks."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(docs: DataFrame) -> DataFrame:
    """package_id, idx, size in bytes and SHA-256 of each document."""
    return docs.select(
        F.col("source").alias("package_id"), F.col("doc_id").alias("idx"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash")
    )


def compressed(docs: DataFrame) -> DataFrame:
    """chunks, with the size of each document's zlib stream as compressed_size."""
    return docs.select(
        F.col("source").alias("package_id"), F.col("doc_id").alias("idx"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"),
        F.length(deflate(F.col("text").cast("binary"))).alias("compressed_size"),
    )


def capped(rows: DataFrame, most: int, size: str = "size") -> DataFrame:
    """Rows of each package in order until the running size would exceed the cap; packing stops there.

    size names what is summed: size, or compressed_size for a cap on what is sent.
    """
    w = Window.partitionBy("package_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(size).over(w).cast("long")).filter(F.col("upto") <= most)


def report(states: DataFrame) -> DataFrame:
    """Of validated rows (package_id, state): rows, those fine, and the share of these, per package and over all (null)."""
    g = states.rollup("package_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "ok").alias("ok"))
    return g.withColumn("success", F.round(F.col("ok") / F.col("n"), 6))


def catalog(rows: DataFrame) -> DataFrame:
    return rows.groupBy("package_id").agg(F.count("*").alias("n_chunks"), F.sum("size").cast("long").alias("total"))


def validate(manifest: DataFrame, have: DataFrame) -> DataFrame:
    """idx and state (ok, missing, mismatch) of each manifest row; have: idx, got."""
    j = manifest.join(have.withColumn("_there", F.lit(True)), "idx", "left")
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("got") != F.col("hash"), "mismatch").otherwise("ok")
    return j.select("idx", state.alias("state"))


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct hashes that are wanted and not there."""
    return wanted.select("hash").distinct().join(have.select("hash").distinct(), "hash", "left_anti")


def _deflated(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else zlib.compress(bytes(b)))


def _inflated(payload: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        try:
            return zlib.decompress(bytes(b))
        except zlib.error:
            return bytes(b)

    return payload.map(one)


def deflate(payload: Column) -> Column:
    return F.pandas_udf(_deflated, "binary")(payload)


def inflate(payload: Column) -> Column:
    """Uncompressed bytes; what is no zlib stream is taken as it is."""
    return F.pandas_udf(_inflated, "binary")(payload)
