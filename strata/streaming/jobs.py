"""Streams: daily windows, de-duplication within a watermark, log appends. Each works on a batch frame as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and sums per event type and day; events later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select("event_type", F.to_date("w.start").alias("day"), "n", "total")


def first_seen(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before, within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only Parquet log, exactly once per checkpoint, for what is there now."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def each_batch(rows: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync(rows: DataFrame, store: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet store the rows of each batch whose key is not there yet, once each: an incremental sync.

    A batch that is run again finds its keys in the store and appends nothing.
    """

    def act(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        try:
            have = batch.sparkSession.read.parquet(store).select(key)
            new = new.join(have, key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        new.write.mode("append").parquet(store)

    return each_batch(rows, act, checkpoint)
