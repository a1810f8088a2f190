"""Governance: filters, exact and semantic de-duplication, conflicts, line cleaning. Every drop has a reason."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import numeric_claims, squeezed
from strata.operators.lookup import look_up
from strata.operators.retrieve import unit_rows
from strata.sources.shared import materialise

#: Fixed patterns of lines that are no text.
PAGE_LINE = "^[\\s\\-—–·.]{0,6}\\d{1,4}[\\s\\-—–·.]{0,6}$"
HEAD_LINE = (
    "^(?:第\\s*[一二三四五六七八九十\\d]+\\s*[章节单元].{0,16}|[\\u4e00-\\u9fff]{2,12}(?:选择性必修|必修).{0,12}|人教版?.{0,12}|普通高中教科书.{0,10})$"
)
FIGURE_LINE = "^(图|表)\\s*[\\d一二三四五六七八九十]+\\s*[-－—]?\\s*\\d*\\s*$"
ORDINAL_LINE = "^\\s*[（(]?\\s*(?:\\d{1,3}|[①-⑳])\\s*[）).、]?\\s*$"
COPYRIGHT = (
    "ISBN\\s*[\\d\\-X]{10,17}|CIP\\s*数据核字|版权所有[，,]?\\s*(?:翻|译|编)|人民教育出版社|出版发行[:：]|印刷[:：]|责任编辑|书\\s*号[:：]\\s*[A-Z]?\\d|"
    "开\\s*本\\s*\\d|字\\s*数\\s*[\\d十百千万]|印\\s*张\\s*\\d|定\\s*价\\s*[\\d.]+\\s*元|印刷厂|质量监督检测|教育部(?:审定|批准)"
)


def retrievable(doc_type: Column, content_type: Column, status: Column) -> Column:
    """Not a parent, a table of contents, a cover or archived; a missing value never excludes."""
    none = F.lit("")
    return (
        (F.coalesce(doc_type, none) != "parent") & ~F.coalesce(content_type, none).isin("toc", "cover") & (F.coalesce(status, none) != "archived")
    )


def exact_duplicates(chunks: DataFrame, order: str = "chunk_id", within: tuple[str, ...] = ()) -> DataFrame:
    """order, within, dup_of (the first chunk with the same text but for white space; null for kept), dup_reason (exact, empty).

    Texts end in the scan: ids and hashes are a table. The first id of each hash is a partial minimum; a hash of a third of all
    rows is looked up without gathering them. Empty texts have no hash.
    """
    flat = squeezed(F.col("text"))
    h = F.when(flat != "", F.sha2(F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.col(w).cast("string"), F.lit("\x1e")) for w in within], flat), 256))
    c = materialise(chunks.select(*within, order, h.alias("_h")), "hashes")
    first = materialise(c.filter("_h is not null").groupBy("_h").agg(F.min(order).alias("_first"), F.count("*").alias("n")), "first-of-hash")
    j = look_up(c, first, "_h").select(*within, order, F.when(F.col("_first") != F.col(order), F.col("_first")).alias("dup_of"))
    full = j.withColumn("dup_reason", F.when(F.col("dup_of").isNotNull(), "exact"))
    none = c.filter("_h is null").select(*within, order, F.lit(None).cast(c.schema[order].dataType).alias("dup_of"), F.lit("empty").alias("dup_reason"))
    return full.unionByName(none)


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """Pairs a < b of vectors (chunk_id long, vec) with cosine of at least threshold, exact, by pairs of blocks.

    There are as many blocks as hold about block vectors each. Each vector goes to the pairs of its block with every block; a
    task multiplies two blocks as matrices, so it holds two blocks and one product, and only pairs over the threshold are rows.
    """
    v = vectors.select(F.col("chunk_id").cast("long"), "vec")
    blocks = max(1, -(-v.count() // block))
    v = v.withColumn("blk", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = v.withColumn("o", other).select(F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"), "blk", "chunk_id", "vec")

    def run(table: pa.Table) -> pa.Table:
        ids, blk = table.column("chunk_id").to_numpy(), table.column("blk").to_numpy()
        x, at = unit_rows(table.column("vec").combine_chunks())
        order = np.lexsort((ids[at], blk[at]))
        x, ids, blk = x[order], ids[at][order], blk[at][order]
        first = int(np.searchsorted(blk, table.column("p")[0].as_py(), "right"))
        # one block with itself, or the first with the second
        left, right, base = (x, x, 0) if first == len(x) and table.column("p")[0] == table.column("q")[0] else (x[:first], x[first:], first)
        a, b, cosine = [], [], []
        for i in range(0, len(left), 1024):
            score = np.round(left[i : i + 1024] @ right.T, 6)
            r, c = np.nonzero(score >= threshold)
            fine = (r + i < c) if base == 0 else np.full(len(r), True)
            r, c = r[fine], c[fine]
            one, two = ids[r + i], ids[c + base]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
            cosine.append(score[r, c])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.array([], kind)
        return pa.table({"a": join(a, np.int64), "b": join(b, np.int64), "cosine": join(cosine, np.float64)})

    return dealt.groupBy("p", "q").applyInArrow(run, "a long, b long, cosine double").filter("a < b")


def greedy_removals(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(loser, winner, cosine): pairs by falling cosine; a pair with a removed side is skipped; the longer text wins, ties the earlier.

    Rounds instead of a sequence: a pair that is first for both its sides is decided at once, as the sequence would.
    """
    ends = pairs.join(lengths.select(F.col("chunk_id").alias("a"), F.col("n").alias("na")), "a").join(
        lengths.select(F.col("chunk_id").alias("b"), F.col("n").alias("nb")), "b"
    )
    loser = F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    rest = materialise(ends.select("a", "b", "cosine", loser.alias("loser"), F.struct((-F.col("cosine")).alias("c"), "a", "b").alias("k")), "pairs")
    out = None
    while not rest.isEmpty():
        sides = rest.select(F.explode(F.array("a", "b")).alias("x"), "k")
        first = sides.groupBy("x").agg(F.min("k").alias("first"))
        held = rest.join(first.select(F.col("x").alias("a"), F.col("first").alias("fa")), "a")
        held = held.join(first.select(F.col("x").alias("b"), F.col("first").alias("fb")), "b")
        now = materialise(held.filter("k = fa and k = fb").select("a", "b", "cosine", "loser", "k"), "decided")
        out = now if out is None else out.unionByName(now)
        gone = now.select(F.col("loser").alias("x"))
        rest = rest.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti")
        rest = materialise(rest.select("a", "b", "cosine", "loser", "k"), "pairs")
    out = rest if out is None else out
    winner = F.when(F.col("loser") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return out.select("loser", winner.alias("winner"), "cosine")


def dedupe(chunks: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of chunks (chunk_id, text, doc_type, vec): dropped has dup_reason (empty, exact, semantic) and dup_of.

    Exact duplicates go first, then of similar ones of a doc_type the shorter. A chunk without a vector has no similar one, so it
    stays. Kept and dropped together are all chunks.
    """
    exact = materialise(exact_duplicates(chunks.select("chunk_id", "text", "doc_type"), within=("doc_type",)).select("chunk_id", "dup_of", "dup_reason"), "exact")
    left = chunks.join(exact.filter("dup_reason is null").select("chunk_id"), "chunk_id", "left_semi")
    left = materialise(left.select("chunk_id", "doc_type", "vec", F.length("text").alias("n")), "left")
    pairs = similar_pairs(left.filter("vec is not null").select("chunk_id", "vec"), threshold)
    kinds = left.select("chunk_id", "doc_type")
    same = pairs.join(kinds.select(F.col("chunk_id").alias("a"), F.col("doc_type").alias("ka")), "a").join(
        kinds.select(F.col("chunk_id").alias("b"), F.col("doc_type").alias("kb")), "b"
    )
    same = materialise(same.filter(F.col("ka").eqNullSafe(F.col("kb"))).select("a", "b", "cosine"), "similar")
    lost = greedy_removals(same, left.select("chunk_id", "n"))
    gone = exact.filter("dup_reason is not null").unionByName(
        lost.select(F.col("loser").alias("chunk_id"), F.col("winner").alias("dup_of"), F.lit("semantic").alias("dup_reason"))
    )
    gone = materialise(gone, "dropped")
    return chunks.join(gone, "chunk_id", "left_anti"), chunks.join(gone, "chunk_id")


def conflicts(chunks: DataFrame) -> DataFrame:
    """Concepts for which chunks of one concept_key state different numbers: concept_key, field, n_values, chunk_ids."""
    claims = chunks.filter(F.coalesce("concept_key", F.lit("")) != "").select(
        "concept_key", "chunk_id", F.explode(numeric_claims(F.col("text"))).alias("c")
    )
    return conflicting(claims.select("concept_key", "chunk_id", F.col("c.concept").alias("field"), F.col("c.value").alias("value")))


def conflicting(claims: DataFrame) -> DataFrame:
    g = claims.groupBy("concept_key", "field").agg(
        F.countDistinct("value").alias("n_values"), F.countDistinct("chunk_id").alias("n_chunks"), F.sort_array(F.collect_set("value")).alias("values")
    )
    return g.filter("n_values > 1 and n_chunks > 1")


def lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, line (trimmed) and verdict of each line: keep, blank, page, figure, ordinal, head, copyright.

    A running head stays where nothing but blank and dropped lines came before it. All within the chunk's own row.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\f")))
    judged = F.transform(
        trimmed,
        lambda x: F.struct(
            x.alias("line"),
            F.when(x == "", "blank").when(x.rlike(COPYRIGHT), "copyright").when(x.rlike(PAGE_LINE), "page").when(x.rlike(FIGURE_LINE), "figure")
            .when(x.rlike(ORDINAL_LINE), "ordinal").when((F.length(x) <= 24) & x.rlike(HEAD_LINE), "head").otherwise("keep").alias("verdict"),
        ),
    )
    c = chunks.select("chunk_id", judged.alias("l"))
    c = c.withColumn("first", F.array_position(F.transform("l", lambda x: x.verdict.isin("keep", "head")), True))
    rows = c.select("chunk_id", "first", F.posexplode("l").alias("i", "x"))
    verdict = F.when((F.col("x.verdict") == "head") & (F.col("i") + 1 == F.col("first")), "keep").otherwise(F.col("x.verdict"))
    return rows.select("chunk_id", F.col("i").alias("line_no"), F.col("x.line").alias("line"), verdict.alias("verdict"))


def clean(chunks: DataFrame, min_chars: int = 40) -> DataFrame:
    """chunk_id, text, reason: lines judged as above; half or more copyright drops the chunk, as do too few characters left."""
    judged = lines(chunks)
    kept = F.when(F.col("verdict").isin("keep", "blank"), F.struct("line_no", "line"))
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = judged.groupBy("chunk_id").agg(
        F.sort_array(F.collect_list(kept)).alias("k"),
        *[n(v).alias(f"n_{v}") for v in ("page", "head", "figure", "ordinal", "copyright")],
        F.sum(F.when(F.col("verdict") != "copyright", F.length("line") + 1).otherwise(0)).alias("n_text"),
        F.sum(F.length("line") + 1).alias("n_all"),
    )
    text = F.trim(F.regexp_replace(F.array_join(F.transform("k", lambda x: x.line), "\n"), "\n{3,}", "\n\n"))
    text = F.regexp_replace(text, "^\\s+|\\s+$", "")
    g = g.withColumn("text", text)
    short = F.length(squeezed(F.col("text"))) < min_chars
    dropped = sum((F.col(f"n_{v}") for v in ("page", "head", "figure", "ordinal", "copyright")), F.lit(0))
    reason = (
        F.when((F.col("n_copyright") > 0) & (F.col("n_text") < 0.5 * F.col("n_all")), "copyright")
        .when(short & (F.col("text") == ""), "noise").when(short, "too_short")
        .when(dropped > 0, F.concat(F.lit("lines:"), F.concat_ws("/", *[
            F.concat(F.col(f"n_{v}").cast("string"), F.lit(v[0])) for v in ("page", "head", "figure", "ordinal", "copyright")])))
        .otherwise("")
    )
    gone = reason.isin("copyright", "too_short", "noise")
    return g.select("chunk_id", F.when(gone, "").otherwise(F.col("text")).alias("text"), reason.alias("reason"))


def page_of(markers: DataFrame, offsets: DataFrame) -> DataFrame:
    """The page of each offset: of the last marker at or before it, else of the first; 0 without markers.

    Markers and offsets of a document meet in one sorted union; a running last value replaces a range join.
    """
    m = markers.select("doc", F.col("start").alias("at"), F.lit(0).alias("o"), "page")
    o = offsets.select("doc", F.col("at"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("page"))
    w = Window.partitionBy("doc").orderBy("at", "o")
    first = F.first("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.unionByName(o).select("doc", "at", "o", F.coalesce(last, first, F.lit(0)).alias("page")).filter("o = 1").drop("o")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What an idempotent replace leaves: old rows whose key is not in new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)
