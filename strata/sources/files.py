"""File sources and sinks. Paths are read by Spark only, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md", "jsonl", "json")


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, suffix, length, modified of the files below a folder, without read-me files. Contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    f = f.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    return f.filter(~F.lower("name").startswith("readme")).withColumn("suffix", F.lower(F.regexp_extract("name", "\\.([^.]+)$", 1)))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files; other suffixes are status rows with a reason instead of a text."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1))
    known = suffix.isin(*TEXT_SUFFIXES)
    return f.select(
        "path", F.when(known, F.col("content").cast("string")).alias("text"), F.when(~known, F.concat(F.lit("skipped: "), suffix)).alias("reason")
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; blank lines and comments go, bad lines come back whole in _bad."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return lines.select(parsed.alias("j")).select("j.*")


def append_json(df: DataFrame, path: str) -> None:
    """An append-only log."""
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that df has: an idempotent replace by key."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def versioned(df: DataFrame, path: str, version: str) -> None:
    """Write below version=...; earlier versions stay as they are."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def chunk_files(df: DataFrame, path: str, *keys: str) -> None:
    """Chunks (text and other columns) as text files below key=value folders: comment lines of their metadata, then the text."""
    meta = [F.concat(F.lit(f"# {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns if c != "text" and c not in keys]
    df.select(*keys, F.concat_ws("\n", *meta, "text").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def report_lines(df: DataFrame, path: str, title: str) -> None:
    """A table as a Markdown report: a small one, written by one task."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    first = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, value string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = first.unionByName(df.select(F.lit(len(head)).alias("i"), cells.alias("value")))
    rows.coalesce(1).sortWithinPartitions("i", "value").select("value").write.mode("overwrite").text(path)


def save_progress(df: DataFrame, path: str) -> None:
    """Counters of some users in place of those users' older ones; others' stay."""
    replace_partitions(df, path, "user_id")
