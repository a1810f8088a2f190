"""Batch retrieval: many queries against many chunks, each stage a function of DataFrames.

chunks: chunk_id, collection, text (and what a stage names besides); queries: query_id, text. Scores are rounded to six
places before they are ranked and every order ends with a key, so results do not depend on partitioning. Statistics are
kept per collection. Tokens are counted per chunk before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import bigrams, estimate_tokens, overlap, unit_list, units
from strata.sources.shared import materialise

K1, B, RRF_K = 1.5, 0.75, 60
#: Weights of the features, bonuses of content types, priorities of sources.
WEIGHTS: Mapping[str, float] = {
    "similarity": 0.40, "bm25": 0.20, "term_coverage": 0.15, "structure_bonus": 0.10, "source_priority": 0.05,
    "version": 0.05, "grade_affinity": 0.05,
}
STRUCTURE: Mapping[str, float] = {
    "definition": 1.0, "theorem": 1.0, "example": 0.8, "exercise": 0.6, "body": 0.7, "figure_caption": 0.3, "toc": 0.0, "cover": 0.0,
}
PRIORITY: Mapping[str, float] = {"neb": 1.0, "openstax": 0.7, "khanacademy": 0.65}


def postings(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(collection, chunk_id, token, tf, len), and for each chunk a row of the empty token, whose tf is 1.

    With wanted (token) only its tokens are counted: they are told by a semi join before anything is shuffled, so rows of other
    tokens end in the scan. A chunk's tokens lie in one task, so counting is done map-side.
    """
    tokens = chunks.select("collection", "chunk_id", unit_list(F.col("text")).alias("t"))
    rows = tokens.select("collection", "chunk_id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("token"))
    if wanted is not None:
        # the planner broadcasts a table below its threshold, else it sorts and merges
        every = wanted.select("token").distinct().unionByName(wanted.sparkSession.sql("select '' as token"))
        rows = rows.join(materialise(every, "wanted-tokens"), "token", "left_semi")
    return rows.groupBy("collection", "chunk_id", "token", "len").agg(F.count("*").alias("tf"))


def corpus_stats(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of postings, per collection: number of chunks and mean length; per collection and token: document frequency."""
    totals = post.filter("token = ''").groupBy("collection").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    return totals, post.filter("token <> ''").groupBy("collection", "token").agg(F.count("*").alias("df"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int | None = 20) -> DataFrame:
    """query_id, collection, chunk_id, score, rn: per query and collection the best k by BM25 (all if None).

    Texts are read and cut into tokens once, into a table of the postings of query tokens. These meet the queries by an equality
    join; only their matches are scored. idf = ln(1 + (N - df + .5)/(df + .5)).
    """
    wanted = materialise(queries.select("query_id", F.explode(units(F.col("text"))).alias("token")), "query-tokens")
    post = materialise(postings(chunks, wanted), "postings")
    totals, df = corpus_stats(post)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    weights = df.join(totals, "collection").select("collection", "token", "n", "df", "avgdl")
    hits = post.join(materialise(weights, "token-weights"), ["collection", "token"]).select("collection", "chunk_id", "token", part.alias("w"))
    scored = hits.join(wanted, "token").groupBy("query_id", "collection", "chunk_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top(scored, k, "query_id", "collection")


def top(scored: DataFrame, k: int | None, *keys: str) -> DataFrame:
    """The best k rows by score, then chunk_id, of each combination of keys; rn is the rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    ranked = scored.withColumn("rn", F.row_number().over(w))
    return ranked.filter(F.col("rn") <= k) if k else ranked


def unit_rows(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as a matrix of unit rows, and the places they come from; others, null and zero ones are left out."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    size = int(sizes.max(initial=0))
    at = np.flatnonzero((sizes == size) & (sizes > 0))
    if not len(at):
        return np.zeros((0, 1)), at
    x = pc.list_flatten(rows.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    length = np.sqrt((x * x).sum(axis=1))
    fine = length > 0
    return x[fine] / length[fine, None], at[fine]


def dense(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = 4096, each: bool = False) -> DataFrame:
    """Exact cosine top k: every vector against the stated query set, k per query; with each, k per query and collection.

    queries: query_id, qvec; vectors: chunk_id, collection, vec (ids are longs). Queries go to the tasks block at a time, so what
    is sent is bounded; a task multiplies a batch of its vectors with them and keeps the best k of each query, so k rows for
    each query and task are merged. More queries than block mean more passes over the vectors. A vector of another length than
    most of its batch's, of length zero or null has no cosine.
    """
    spark, out = queries.sparkSession, None
    q = materialise(queries.select(F.col("query_id").cast("long"), "qvec"), "query-vectors")
    blocks = max(1, -(-q.count() // block))
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").toArrow()
        sent = spark.sparkContext.broadcast((rows.column(0).to_numpy(), *unit_rows(rows.column(1).combine_chunks())))
        scored = vectors.select(F.col("chunk_id").cast("long"), "collection", "vec").mapInArrow(
            _nearest(sent, k, each), "query_id long, chunk_id long, collection string, score double"
        )
        out = scored if out is None else out.unionByName(scored)
    return top(out.select("query_id", "collection", "chunk_id", F.round("score", 6).alias("score")), k, "query_id", *(["collection"] if each else []))


def _nearest(sent, k: int, each: bool):
    """For mapInArrow over (chunk_id, collection, vec): the best k rows of a task for each query, by rounded score, then id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, at = sent.value
        # by collection (all are one without each), then query: rows of (-score, chunk_id, collection)
        held: dict[str | None, list[list[tuple[float, int, str | None]]]] = {}

        def merge(score: np.ndarray, own: np.ndarray, names: np.ndarray, best: list[list]) -> None:
            n = score.shape[1]
            # all that ties with the k-th best stays until ids decide
            floor = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), -2.0)
            for j, rows in enumerate(best):
                near = np.flatnonzero(score[j] >= max(floor[j], -rows[-1][0] if len(rows) >= k else -2.0))
                if len(near):
                    new = [(-float(score[j, x]), int(own[x]), names[x]) for x in near]
                    best[j] = sorted(rows + new, key=lambda r: r[:2])[:k]

        for batch in batches:
            v, places = unit_rows(batch.column(2))
            if not len(places) or not len(at) or v.shape[1] != asked.shape[1]:
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)[places]
            names = batch.column(1).to_numpy(zero_copy_only=False)[places]
            for i in range(0, len(v), 8192):
                score = np.round(asked @ v[i : i + 8192].T, 6)
                part, told = own[i : i + 8192], names[i : i + 8192]
                for name in set(told) if each else [None]:
                    x = np.flatnonzero(told == name) if each else slice(None)
                    merge(score[:, x], part[x], told[x], held.setdefault(name, [[] for _ in at]))
        rows = [(int(ids[at[j]]), c, name, -s) for best in held.values() for j, found in enumerate(best) for s, c, name in found]
        if rows:
            a, b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.float64())],
                names=["query_id", "chunk_id", "collection", "score"],
            )

    return run


def fuse(routes: DataFrame, k: int | None = 20) -> DataFrame:
    """Reciprocal rank fusion. routes: query_id, route, kind (dense, bm25), collection, chunk_id, score.

    A route's ranks go over all its collections. Per chunk: rrf_score, its share of the best (rrf_norm), best rank and score
    of each kind, number of routes.
    """
    w = Window.partitionBy("query_id", "route").orderBy(F.desc("score"), "collection", "chunk_id")
    ranked = routes.withColumn("rn", F.row_number().over(w))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    fused = ranked.groupBy("query_id", "collection", "chunk_id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rn"))), 6).alias("rrf_score"),
        F.max(of("dense", "score")).alias("dense_score"),
        F.max(of("bm25", "score")).alias("bm25_score"),
        F.min(of("dense", "rn")).alias("dense_rank"),
        F.min(of("bm25", "rn")).alias("bm25_rank"),
        F.count("*").alias("n_routes"),
    )
    best = F.max("rrf_score").over(Window.partitionBy("query_id"))
    fused = fused.withColumn("rrf_norm", F.round(F.col("rrf_score") / best, 6))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rrf_score"), F.desc(F.coalesce("dense_score", F.lit(0.0))), "collection", "chunk_id"
    )
    fused = fused.withColumn("pos", F.row_number().over(order))
    return fused.filter(F.col("pos") <= k) if k else fused


def above_floor(fused: DataFrame, floor: float = 0.30) -> DataFrame:
    """Drops what only the dense route found and below the floor."""
    return fused.filter(~(F.col("bm25_rank").isNull() & (F.coalesce("dense_score", F.lit(0.0)) < floor)))


def table_lookup(table: Mapping[str, float], key: Column, default: float) -> Column:
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def source_priority(collection: Column, source: Column) -> Column:
    out = F.when(F.lower(collection).contains("neb") | F.lower(source).contains("neb"), PRIORITY["neb"])
    for name, value in PRIORITY.items():
        out = out.when(F.lower(source).contains(name), value)
    return out.otherwise(0.5)


def grade_affinity(grade: Column, span: Column, wanted: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(span, F.lit("")), ","), lambda s: F.trim(s))
    return (
        F.when(F.coalesce(wanted, F.lit("")) == "", 0.5).when(grade == wanted, 1.0)
        .when(F.array_contains(parts, wanted), 0.8).otherwise(0.2)
    )


def version_feature(edition: Column) -> Column:
    year = F.regexp_extract(F.coalesce(edition, F.lit("")), "(?:19|20)\\d{2}", 0)
    return F.when(year == "", 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year.cast("int") - 2015) / 10.0)))


def rerank(candidates: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Weighted sum of seven features, over the sum of the weights; texts under ten characters go.

    candidates: query_id, query, collection, chunk_id, text, dense_score, bm25_score, content_type, source, edition, grade,
    grade_span, wanted_grade, and perhaps variants (array of further wordings): query_coverage, which has no weight, is the best of
    all wordings.
    """
    c = candidates.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 10)
    most = F.max(F.coalesce("bm25_score", F.lit(0.0))).over(Window.partitionBy("query_id"))
    asked = units(F.col("query"))
    covered = overlap(bigrams(F.col("query")), bigrams(F.col("text")))
    if "variants" in candidates.columns:
        others = F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda v: overlap(bigrams(v), bigrams(F.col("text"))))
        covered = F.greatest(covered, F.coalesce(F.array_max(others), F.lit(0.0)))
    c = c.select(
        "*",
        F.coalesce("dense_score", F.lit(0.0)).alias("similarity"),
        F.when(most > 0, F.coalesce("bm25_score", F.lit(0.0)) / most).otherwise(0.0).alias("bm25"),
        F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, units(F.col("text")))) / F.size(asked)).otherwise(0.0).alias("term_coverage"),
        F.round(covered, 6).alias("query_coverage"),
        table_lookup(STRUCTURE, F.lower("content_type"), 0.5).alias("structure_bonus"),
        source_priority(F.col("collection"), F.col("source")).alias("source_priority"),
        version_feature(F.col("edition")).alias("version"),
        grade_affinity(F.col("grade"), F.col("grade_span"), F.col("wanted_grade")).alias("grade_affinity"),
    )
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return c.withColumn("final_score", F.round(total / F.lit(sum(weights.values())), 6))


def narrow_grades(ranked: DataFrame, least: int = 2, affinity: float = 0.8) -> DataFrame:
    """Where a query has at least so many rows of its grade, only those stay."""
    n = F.count_if(F.col("grade_affinity") >= affinity).over(Window.partitionBy("query_id"))
    return ranked.withColumn("n_same", n).filter((F.col("n_same") < least) | (F.col("grade_affinity") >= affinity)).drop("n_same")


def best(ranked: DataFrame, k: int = 10, floor: float = 0.40) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "collection", "chunk_id")
    return ranked.filter(F.col("final_score") >= floor).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expand_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Children give way to their parents; without one they stay. The first child of a parent wins.

    hits: query_id, collection, chunk_id, parent_id, text, rank; parents: collection, parent_id, parent_text. With meta (a map) in
    hits and parent_meta in parents, entries of the child that are not empty stand over the parent's.
    """
    j = hits.join(parents, ["collection", "parent_id"], "left")
    if "meta" in hits.columns and "parent_meta" in parents.columns:
        own = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("")) != "")
        rest = F.map_filter(F.coalesce("parent_meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(own), k))
        j = j.withColumn("meta", F.map_concat(rest, own)).drop("parent_meta")
    key = F.coalesce(F.when(F.col("parent_text").isNotNull(), F.concat(F.lit("parent:"), F.col("parent_id").cast("string"))), F.concat(F.lit("child:"), F.col("chunk_id").cast("string")))
    j = j.withColumn("unit", key).withColumn("text", F.coalesce("parent_text", "text"))
    w = Window.partitionBy("query_id", "collection", "unit").orderBy("rank", "chunk_id")
    return j.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "parent_text")


#: Sentence ends in the order in which a cut text looks for one.
ENDS = ("。", "！", "？", "；", ".", "!", "?")


def cut_to(text: Column, budget: int) -> Column:
    """The first budget characters, which are no more tokens than that, up to the last sentence end of the first kind there is."""
    cut = F.substring(text, 1, max(1, budget))
    out = cut
    for end in reversed(ENDS):
        at = F.instr(F.reverse(cut), end)
        out = F.when(at > 0, F.substr(cut, F.lit(1), F.length(cut) - at + 1)).otherwise(out)
    return out


def pack_evidence(ranked: DataFrame, budget: int = 2000, items: int = 4) -> DataFrame:
    """Greedy by score per token: what does not fit is skipped, at most items; if nothing fits, the best one is cut to the budget.

    One fold over each query's candidates, which rerank has bounded. Gives query_id, chunk_id, text, tokens, final_score, seq.
    """
    c = ranked.select("query_id", "chunk_id", "final_score", "text", estimate_tokens(F.col("text")).alias("tokens")).filter("tokens > 0")
    value = F.round(F.greatest("final_score", F.lit(1e-6)) / F.col("tokens"), 9)
    rows = c.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct((-value).alias("v"), "chunk_id", "tokens", "final_score", "text"))).alias("rows")
    )
    kind = rows.schema["rows"].dataType.simpleString()
    packed = F.aggregate(
        "rows",
        F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("kept")),
        lambda acc, x: F.when(
            (F.size(acc.kept) < items) & (acc.used + x.tokens <= budget),
            F.struct((acc.used + x.tokens).alias("used"), F.concat(acc.kept, F.array(x)).alias("kept")),
        ).otherwise(acc),
    )
    rows = rows.select("query_id", "rows", packed.kept.alias("kept"))
    # nothing fits: the best by score, cut to the budget
    first = F.array_sort("rows", lambda a, b: F.when(a.final_score > b.final_score, -1).when(a.final_score < b.final_score, 1)
                         .when(a.chunk_id < b.chunk_id, -1).otherwise(1))
    alone = F.transform(F.slice(first, 1, 1), lambda x: x.withField("text", cut_to(x.text, budget)))
    alone = F.transform(alone, lambda x: x.withField("tokens", estimate_tokens(x.text)))
    out = rows.select("query_id", F.explode(F.when(F.size("kept") > 0, F.col("kept")).otherwise(alone)).alias("x"))
    out = out.select("query_id", "x.chunk_id", "x.text", "x.tokens", "x.final_score")
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")
    return out.withColumn("seq", F.row_number().over(w))


def cite(evidence: DataFrame) -> DataFrame:
    """Adds label: title, chapter and page of numbered evidence, or its number."""
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("第"), F.col("page").cast("string"), F.lit("页")))
    text = F.concat_ws(" · ", F.nullif("title", F.lit("")), F.nullif("chapter", F.lit("")), page)
    return evidence.withColumn("label", F.when(text != "", text).otherwise(F.concat(F.lit("来源"), F.col("seq").cast("string"))))


def refusals(queries: DataFrame, ranked: DataFrame, least: float = 0.28) -> DataFrame:
    """query_id, n_evidence, best_coverage, refused: no evidence, or too little of the question in it."""
    best_of = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max("query_coverage").alias("c"))
    return queries.select("query_id").join(best_of, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0)).alias("n_evidence"),
        F.coalesce("c", F.lit(0.0)).alias("best_coverage"),
        (F.coalesce("n", F.lit(0)) == 0).__or__(F.coalesce("c", F.lit(0.0)) < least).alias("refused"),
    )
