"""Joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_up(rows: DataFrame, table: DataFrame, key: str, least: int = 4096, most: int = 50_000) -> DataFrame:
    """rows with the columns of table by an inner join on key, for keys that may hold a third of all rows.

    table has a row for each key with n, the number of rows of that key. Keys of more than least rows, and of more than one
    part in most of all rows, are sent to every task: at most most keys, so their size is bounded. The others are joined by a
    shuffle in which no key is large. Null keys match nothing. Both should be tables: they are read twice.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = table.filter(F.col("n") > max(least, total // most)).drop("n")
    cold = table.filter(F.col("n") <= max(least, total // most)).drop("n")
    if hot.isEmpty():
        return rows.join(cold, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
