"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; its failure is one bit of ``fail_bits`` and its measurement a column.
A policy is a versioned mask of bits: keeping, comparing policies and ablating rules need the bits only, never the texts.
Built-in functions only: no Python runs on the executors.

Cases: a null or empty text has no words and fails ``few_words``; null ids stay null; repeated rows and tied values are
judged one by one; an empty table gives an empty ledger; other columns of the input are not carried along, so none clashes.
A very long text stays one row: its windows are 64-bit hashes, sorted within the row only if one of them repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import SPACE, text_of

WINDOW = 8

#: Rules by bit number: name and failing condition over the measurements. Ratios are compared as whole numbers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("capitals", "n_letters > 0 and 10 * n_capitals > 6 * n_letters"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals")


def _repeat_words(hashes: Column) -> tuple[Column, Column]:
    """The hashes of all 8-word windows, and whether one is there twice."""
    n = F.size(hashes)
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows, F.size(F.array_distinct(F.col("_windows"))) < F.size(F.col("_windows"))


def _measured(docs: DataFrame, carried: Column, text: Column) -> DataFrame:
    """The carried struct as column doc, with the measurements in MEASURES."""
    d = docs.select(carried.alias("doc"), text.alias("_text"))
    text = F.col("_text")
    removed = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc",
        F.transform(words, lambda w: F.xxhash64(w)).alias("_hashes"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_lines"),
        (F.length(text) - removed(f"{SPACE}+")).cast("long").alias("word_chars"),
        removed(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        removed(r"\p{L}+").cast("long").alias("n_letters"),
        removed(r"\p{Lu}+").cast("long").alias("n_capitals"),
    )
    windows, twice = _repeat_words(F.col("_hashes"))
    d = d.select(
        "*",
        F.size("_hashes").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Only a text with a repeated window is sorted: (hash, place) pairs, then the places whose neighbour has the same hash.
    d = d.withColumn(
        "_pairs",
        F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    same = lambda p, i: F.coalesce(F.get(F.col("_pairs"), i).h == p.h, F.lit(False))
    d = d.withColumn(
        "_places",
        F.sort_array(F.transform(F.filter("_pairs", lambda p, i: same(p, i - 1) | same(p, i + 1)), lambda p: p.i)),
    )
    covered = F.transform(
        "_places", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), k + 1) - s, F.lit(WINDOW)))
    )
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return d.select("doc", *MEASURES)


def _with_bits(measured: DataFrame) -> DataFrame:
    """Adds fail_bits.

    The partition number, never negative, makes this a projection that the optimiser does not push a filter through: pushed
    down, a filter on a verdict would hold every measurement spelled out again at each use.
    """
    bits = F.when(F.spark_partition_id() < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    for i, (_, condition) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements and fail_bits, whose bit i is set if rule i of RULES fails."""
    measured = _with_bits(_measured(docs, F.struct(docs[id_col].alias("doc_id")), text_of(docs, text_col)))
    return measured.select("doc.doc_id", *MEASURES, "fail_bits")


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Add base_failed and kept, by the mask of a version in POLICIES."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", hit(POLICIES["base"])).withColumn(
        "kept", ~hit(POLICIES[version] | POLICIES["base"])
    )


def ablate(rows: DataFrame, version: str = "v1") -> DataFrame:
    """One row per rule of a policy: documents it rejects, and those no other rule of the policy rejects.

    The ledger is first summed by its bits, so what follows has at most two to the number of rules rows.
    """
    mask = POLICIES[version]
    sums = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask]
    )
    return (
        sums.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejects"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejects_alone"),
        )
    )


def filter_documents(docs: DataFrame, version: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs."""
    measured = _with_bits(_measured(docs, F.struct(*[docs[c] for c in docs.columns]), text_of(docs, text_col)))
    return apply_policy(measured, version).filter("kept").select("doc.*")
