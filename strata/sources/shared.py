"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and the session is a local one (tests).

    Executors elsewhere would each write to a disk of their own, so on a cluster without that setting this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    return own


#: Folders of the tables that this process has made and not dropped.
_MADE: list[str] = []


def made() -> int:
    """A mark for drop_made: how many tables there are."""
    return len(_MADE)


def drop_made(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables made since a mark, but for the last keep. Nothing that is still to be read may depend on them."""
    end = max(since, len(_MADE) - keep)
    gone, _MADE[since:end] = _MADE[since:end], []
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    The planner knows the table's size from its files, so it broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)
