"""Event-time and cube plans on the star tables: what Spark adds to the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.plans.registry import query
from strata.sources import files
from strata.streaming import jobs
from strata.sources.tables import Tables


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def x_event_daily(t: Tables) -> DataFrame:
    return jobs.daily(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select("event_type", "day", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid""")
def x_event_sessions(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return s.select("user_id", F.regexp_replace(F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "\\.?0+$", "").alias("start"), "n")


@query("""SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def x_cube_orders(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def x_rollup_region(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query()
def src_files(t: Tables) -> DataFrame:
    """The table files of the folder, by Spark's reader."""
    return files.discover(t.spark, t.sf_dir, "*.parquet").select("name", "suffix", (F.col("length") > 0).alias("filled"))
