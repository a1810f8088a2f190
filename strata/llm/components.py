"""Connected components of a link table, by alternating large and small stars (Kiveris et al., 2014).

Every round halves the depth at least. A hub costs a partial minimum; its links are not gathered, since hubs are looked up in a
table of bounded size that every task has (look_up). Links live in tables of the shared folder; the driver sees a count and a
checksum per round.

Cases: links with a null end and loops are left out; repeated links count once; an empty table gives an empty result; other
columns are not carried along; nodes may be of any type that can be ordered and hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import look_up, materialise


def _stars(links: DataFrame) -> DataFrame:
    """A large-star step: each node's larger neighbours are linked to its smallest one."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    least = least.select("a", F.least("a", "m").alias("m"), "n")
    return look_up(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """A small-star step over links a > b: each node and its smaller neighbours are linked to the smallest."""
    least = materialise(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    joined = look_up(links, least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its component."""
    state = None
    links = materialise(
        links.filter("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not seen[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        links = materialise(_small(materialise(_stars(links), "stars")), "links")
