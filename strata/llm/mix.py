"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source's target is its weight's share of the total, at most max_epochs times its size; the excess goes to the other
sources by weight until none is above. Every document of a source is taken floor(target / size) times; the fraction left
is filled with one more repetition of documents in the order of a seeded hash, up to the target.

Scale: sizes are summed by (source, slice of the hash range) before anything is shuffled by source. The place in hash order
where a source's fraction ends lies in one slice of SLICES; only the documents of that slice are ordered in a window, so a
source with a third of all rows is never gathered in one task. Tables of one row per source go through one task.

Cases: a null source is a source, last in order; null and empty texts have size 0 and are taken in whole repetitions only; a
source of size 0 has target 0 and is not taken; null ids and repeated rows are judged row by row (equal rows are ordered
arbitrarily among themselves, so reruns take equally many); a very long text counts with all its words; an empty table gives an empty result; the input's other columns
and names starting with ``_mix_`` do not meet, the latter are dropped from the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD, materialise, text_of

SLICES_LOG2 = 12
SEED = 20240501


def sized(docs: DataFrame, seed: int = SEED, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with _mix_source, _mix_size (words), _mix_h (seeded hash) and _mix_slice (its top bits)."""
    docs = docs.select(*[docs[c] for c in docs.columns if not c.startswith("_mix_")])
    text = text_of(docs, text_col)
    none = F.lit("")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), none), F.lit(":"), F.coalesce(docs[source_col], none))
    # 60 bits of a hash that other engines have too
    h = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    return docs.select(
        "*",
        docs[source_col].alias("_mix_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_mix_size"),
        h.alias("_mix_h"),
    ).withColumn("_mix_slice", F.shiftright("_mix_h", 60 - SLICES_LOG2).cast("int"))


def plan(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source of sized rows: _mix_source, source_size, target, whole, cut (slice where the fraction ends), rest.

    weights repeat over the sources in code point order, null last. Slices below cut are taken once more entirely, of slice
    cut as many documents as rest words hold.
    """
    by_slice = rows.groupBy("_mix_source", "_mix_slice").agg(F.sum("_mix_size").alias("n"))
    by_slice = materialise(by_slice, "mix-slices")
    sources = by_slice.groupBy("_mix_source").agg(F.sum("n").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_mix_source").isNull(), "_mix_source"))
    everything = Window.partitionBy()
    sources = sources.withColumn("rank", rank)
    sources = sources.select(
        "_mix_source",
        "source_size",
        "rank",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights)).alias("w"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    # In the order of cap / weight the capped sources come first: the level is what the rest share, at the first source
    # whose cap is not below it.
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "rank", "level"))).over(everything)
    target = F.least("cap", F.coalesce(first["level"] * F.col("w"), F.col("cap")))
    sources = sources.select("_mix_source", "source_size", target.alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole)
    sources = sources.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    along = Window.partitionBy("_mix_source").orderBy("_mix_slice")
    reached = by_slice.withColumn("upto", F.sum("n").over(along))
    reached = reached.join(
        sources.select(F.col("_mix_source").alias("s"), "want"), F.col("_mix_source").eqNullSafe(F.col("s"))
    ).filter(F.col("upto") > F.col("want"))
    cuts = reached.groupBy("_mix_source").agg(
        F.min(F.struct("_mix_slice", (F.col("want") - F.col("upto") + F.col("n")).alias("rest"))).alias("c")
    )
    cuts = cuts.select(F.col("_mix_source").alias("s"), F.col("c._mix_slice").alias("cut"), F.col("c.rest").alias("rest"))
    out = sources.join(cuts, F.col("_mix_source").eqNullSafe(F.col("s")), "left")
    return materialise(
        out.select(
            "_mix_source",
            "source_size",
            "target",
            "whole",
            F.coalesce("cut", F.lit(1 << SLICES_LOG2)).alias("cut"),
            F.coalesce("rest", F.lit(0.0)).alias("rest"),
        ),
        "mix-plan",
    )


def apply(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Sized rows with source_size, target and reps, the times each row is taken."""
    p = planned.select(F.col("_mix_source").alias("_mix_s"), "source_size", "target", "whole", "cut", "rest")
    p = p.select("_mix_s", F.struct("source_size", "target", "whole", "cut", "rest").alias("_mix_p"))
    joined = rows.join(p, F.col("_mix_source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s")
    apart = joined.filter(F.col("_mix_slice") != F.col("_mix_p.cut")).withColumn(
        "_mix_more", (F.col("_mix_slice") < F.col("_mix_p.cut")).cast("int")
    )
    order = Window.partitionBy("_mix_source").orderBy("_mix_h", "_mix_size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_mix_size").over(order)
    within = joined.filter(F.col("_mix_slice") == F.col("_mix_p.cut")).withColumn(
        "_mix_more", (2 * upto - F.col("_mix_size") < 2 * F.col("_mix_p.rest")).cast("int")
    )
    more = F.when(F.col("_mix_size") > 0, F.col("_mix_more")).otherwise(0)
    return apart.unionByName(within).withColumn("_mix_reps", F.col("_mix_p.whole") + more)


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, reps, taken of every document; options of sized and plan."""
    seed = options.pop("seed", SEED)
    rows = materialise(
        sized(docs.select("doc_id", "source", "text"), seed).select(
            "doc_id", "_mix_source", "_mix_size", "_mix_h", "_mix_slice"
        ),
        "mix-sizes",
    )
    taken = apply(rows, plan(rows, **options))
    return taken.select(
        "doc_id",
        F.col("_mix_source").alias("source"),
        F.col("_mix_size").alias("size"),
        F.col("_mix_p.source_size").cast("long").alias("source_size"),
        F.col("_mix_p.target").alias("target"),
        F.col("_mix_reps").alias("reps"),
        (F.col("_mix_size") * F.col("_mix_reps")).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    seed = options.pop("seed", SEED)
    held = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_held"), docs["doc_id"], docs["source"], docs["text"]
    )
    sizes = materialise(
        sized(docs.select("doc_id", "source", "text"), seed).select("_mix_source", "_mix_size", "_mix_slice"), "mix-sizes"
    )
    rows = sized(held, seed).drop("doc_id", "source", "text")
    taken = apply(rows, plan(sizes, **options)).filter("_mix_reps > 0")
    return taken.select("_held", F.explode(F.sequence(F.lit(1).cast("long"), "_mix_reps"))).select("_held.*")
