"""The Parquet tables of a folder, by attribute, and the views of them that stand in for the library's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """t.documents reads sf_dir/documents.parquet, and so on. Reads are lazy: columns and filters reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self) -> DataFrame:
        """documents as chunks: chunk_id, text, collection (the source), discipline (the language), grade 1 to 3."""
        return self.documents.select(
            F.col("doc_id").alias("chunk_id"),
            "text",
            F.col("source").alias("collection"),
            F.col("lang").alias("discipline"),
            (1 + F.col("doc_id") % 3).cast("string").alias("grade"),
        )

    def questions(self) -> DataFrame:
        """benchmark items as queries: query_id, text."""
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def turns(self) -> DataFrame:
        """User turns of conversations with the assistant's next turn: conv_id, turn, q, a."""
        c = self.conversations
        user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
        reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
        return user.join(reply, ["conv_id", "turn"])

    def attempts(self) -> DataFrame:
        """events as learners' attempts: user_id, subject, concept, question, correct."""
        return self.events.select(
            "event_id",
            "user_id",
            F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("subject"),
            F.col("event_type").alias("concept"),
            (F.col("event_id") % 7).alias("question"),
            (F.col("value") > 250).cast("int").alias("correct"),
        )

    def values(self, sql: str) -> DataFrame:
        """A small literal table."""
        return self.spark.sql(sql)
