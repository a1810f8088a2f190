"""Plans of retrieval, from postings to the whole pipeline.

Documents have no vectors and embeddings no text: chunk i has the vector i and question i the vector i, where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import answer as answers, retrieve, route as routing
from strata.plans.registry import query
from strata.sources.shared import materialise
from strata.sources.tables import Tables

W = "[a-z0-9_]+"
BM25 = f"""
tok AS (SELECT source AS collection, doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM documents),
len_ AS (SELECT source AS collection, doc_id AS chunk_id, len(regexp_extract_all(lower(text), '{W}')) AS len FROM documents),
post AS (SELECT collection, chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL),
tot AS (SELECT collection, count(*) AS n, avg(len) AS avgdl FROM len_ GROUP BY ALL),
dfs AS (SELECT collection, token, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}')) AS token FROM benchmark),
sc AS (SELECT query_id, p.collection, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
 FROM qt JOIN post p USING (token) JOIN dfs d ON d.collection = p.collection AND d.token = p.token JOIN tot t ON t.collection = p.collection
 JOIN len_ l ON l.collection = p.collection AND l.chunk_id = p.chunk_id GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS rn FROM sc QUALIFY rn <= 20)"""
DENSE = """
dn AS (SELECT q.vec_id AS query_id, d.source AS collection, v.vec_id AS chunk_id,
  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rn
 FROM (SELECT e.* FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id) q CROSS JOIN embeddings v JOIN documents d ON d.doc_id = v.vec_id QUALIFY rn <= 20)"""
FUSED = f"""
{BM25}, {DENSE},
routes AS (SELECT query_id, 0 AS route, 'dense' AS kind, collection, chunk_id, score FROM dn UNION ALL SELECT query_id, 1, 'bm25', collection, chunk_id, score FROM bm),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, collection, chunk_id) AS rn2 FROM routes),
fu AS (SELECT query_id, collection, chunk_id, round(sum(1.0::DOUBLE / (60 + rn2)), 6) AS rrf_score, max(score) FILTER (kind = 'dense') AS dense_score,
  max(score) FILTER (kind = 'bm25') AS bm25_score, min(rn2) FILTER (kind = 'dense') AS dense_rank, min(rn2) FILTER (kind = 'bm25') AS bm25_rank FROM rk GROUP BY ALL),
fp AS (SELECT *, round(rrf_score / max(rrf_score) OVER (PARTITION BY query_id), 6) AS rrf_norm,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(dense_score, 0) DESC, collection, chunk_id) AS pos FROM fu),
fused AS (SELECT * FROM fp WHERE pos <= 20)"""
U = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9_]+'))"
G = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_]+'))"
RANKED = f"""
{FUSED},
cand AS (SELECT f.*, d.text, b.text AS query, CASE d.doc_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.5 END AS structure_bonus,
  CASE WHEN CAST(1 + d.doc_id % 3 AS VARCHAR) = CAST(1 + b.item_id % 3 AS VARCHAR) THEN 1.0 ELSE 0.2 END AS grade_affinity
 FROM fused f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id
 WHERE NOT (bm25_rank IS NULL AND coalesce(dense_score, 0) < 0.30) AND length(trim(d.text)) >= 10),
feat AS (SELECT *, coalesce(dense_score, 0) AS similarity, CASE WHEN max(coalesce(bm25_score, 0)) OVER (PARTITION BY query_id) > 0
   THEN coalesce(bm25_score, 0) / max(coalesce(bm25_score, 0)) OVER (PARTITION BY query_id) ELSE 0 END AS bm25n,
  len(list_intersect({U.format('query')}, {U.format('text')})) / len({U.format('query')}) AS term_coverage,
  round(len(list_intersect({G.format('query')}, {G.format('text')})) / len({G.format('query')}), 6) AS query_coverage FROM cand),
ranked AS (SELECT *, round((0.40::DOUBLE * similarity + 0.20::DOUBLE * bm25n + 0.15::DOUBLE * term_coverage + 0.10::DOUBLE * structure_bonus + 0.05::DOUBLE * 0.5
  + 0.05::DOUBLE * 0.5 + 0.05::DOUBLE * grade_affinity) / 1.0, 6) AS final_score FROM feat)"""


def vectors(t: Tables) -> DataFrame:
    own = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("collection"))
    return own.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), "chunk_id")


def asked_vectors(t: Tables) -> DataFrame:
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return own.join(t.questions().select("query_id"), "query_id")


def fused(t: Tables) -> DataFrame:
    dense = retrieve.dense(asked_vectors(t), vectors(t)).select("query_id", F.lit(0).alias("route"), F.lit("dense").alias("kind"), "collection", "chunk_id", "score")
    words = retrieve.bm25(t.questions(), t.chunks()).select("query_id", F.lit(1).alias("route"), F.lit("bm25").alias("kind"), "collection", "chunk_id", "score")
    return retrieve.fuse(dense.unionByName(words))


def ranked(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("body", "definition", "example", "other")])
    chunk = t.chunks().select(
        "chunk_id", "text", F.lit("web").alias("source"), F.lit("").alias("edition"), "grade", F.lit("").alias("grade_span"),
        F.get(kinds, (F.col("chunk_id") % 4).cast("int")).alias("content_type"),
    )
    asked = t.questions().select("query_id", F.col("text").alias("query"), (1 + F.col("query_id") % 3).cast("string").alias("wanted_grade"))
    c = retrieve.above_floor(fused(t)).join(chunk, "chunk_id").join(asked, "query_id")
    # a few candidates for each query, used for evidence and for refusals
    return materialise(retrieve.rerank(c), "ranked")


@query(f"WITH {BM25} SELECT collection, CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT CAST(count(*) AS BIGINT) FROM dfs WHERE dfs.collection = tot.collection) AS tokens FROM tot")
def bm25_stats(t: Tables) -> DataFrame:
    chunks = t.chunks()
    totals, df = retrieve.corpus_stats(materialise(retrieve.postings(chunks), "postings"))
    return totals.join(df.groupBy("collection").agg(F.count("*").alias("tokens")), "collection").select("collection", "n", F.round("avgdl", 6).alias("avgdl"), "tokens")


@query(f"WITH {BM25} SELECT query_id, collection, chunk_id, score, CAST(rn AS INTEGER) AS rn FROM bm WHERE rn <= 5")
def bm25_topk(t: Tables) -> DataFrame:
    return retrieve.bm25(t.questions(), t.chunks(), 5).select("query_id", "collection", "chunk_id", "score", "rn")


@query(f"WITH {DENSE} SELECT query_id, collection, chunk_id, score, CAST(rn AS INTEGER) AS rn FROM dn")
def dense_topk(t: Tables) -> DataFrame:
    return retrieve.dense(asked_vectors(t), vectors(t)).select("query_id", "collection", "chunk_id", "score", "rn")


@query(f"WITH {FUSED} SELECT query_id, collection, chunk_id, rrf_score, rrf_norm, dense_score, bm25_score, CAST(pos AS INTEGER) AS pos FROM fused")
def rrf_fuse(t: Tables) -> DataFrame:
    return fused(t).select("query_id", "collection", "chunk_id", "rrf_score", "rrf_norm", "dense_score", "bm25_score", "pos")


@query(f"WITH {FUSED} SELECT query_id, chunk_id FROM fused WHERE NOT (bm25_rank IS NULL AND coalesce(dense_score, 0) < 0.30)")
def min_base(t: Tables) -> DataFrame:
    return retrieve.above_floor(fused(t)).select("query_id", "chunk_id")


@query(f"WITH {RANKED} SELECT query_id, chunk_id, round(term_coverage, 6) AS term_coverage, query_coverage, final_score FROM ranked")
def rerank(t: Tables) -> DataFrame:
    return ranked(t).select("query_id", "chunk_id", F.round("term_coverage", 6).alias("term_coverage"), "query_coverage", "final_score")


NARROW = f"""{RANKED}, nr AS (SELECT *, count(*) FILTER (grade_affinity >= 0.8) OVER (PARTITION BY query_id) AS same FROM ranked),
narrowed AS (SELECT * FROM nr WHERE same < 2 OR grade_affinity >= 0.8),
top10 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, collection, chunk_id) AS rank FROM narrowed WHERE final_score >= 0.25 QUALIFY rank <= 10)"""


@query(f"WITH {NARROW} SELECT query_id, chunk_id, grade_affinity::DOUBLE AS grade_affinity FROM narrowed")
def grade_narrow(t: Tables) -> DataFrame:
    return retrieve.narrow_grades(ranked(t)).select("query_id", "chunk_id", "grade_affinity")


@query(f"""WITH {RANKED}, b AS (SELECT query_id, count(*) AS n, max(query_coverage) AS c FROM ranked GROUP BY 1)
SELECT item_id AS query_id, CAST(coalesce(n, 0) AS BIGINT) AS n_evidence, coalesce(c, 0.0)::DOUBLE AS best_coverage, coalesce(n, 0) = 0 OR coalesce(c, 0) < 0.28 AS refused
FROM benchmark LEFT JOIN b ON b.query_id = item_id""")
def refuse(t: Tables) -> DataFrame:
    return retrieve.refusals(t.questions(), ranked(t))


@query(f"""WITH {RANKED}, b AS (SELECT query_id, count(*) AS n, max(final_score) AS s FROM ranked GROUP BY 1)
SELECT item_id AS query_id, coalesce(n, 0) = 0 OR coalesce(s, 0) < 0.45 AS failed FROM benchmark LEFT JOIN b ON b.query_id = item_id""")
def failures(t: Tables) -> DataFrame:
    b = ranked(t).groupBy("query_id").agg(F.max("final_score").alias("s"))
    return t.questions().join(b, "query_id", "left").select("query_id", (F.coalesce("s", F.lit(0.0)) < 0.45).alias("failed"))


PARENT = f"""{NARROW}, ex AS (SELECT t.*, t.chunk_id // 4 AS parent_id, (t.chunk_id // 4) % 5 <> 0 AS has FROM top10 t),
exr AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection, CASE WHEN has THEN 'p' || parent_id ELSE 'c' || chunk_id END ORDER BY rank, chunk_id) AS k FROM ex QUALIFY k = 1)"""


def expanded(t: Tables) -> DataFrame:
    """The best ten, children replaced by parents of four documents where those exist."""
    hits = retrieve.best(retrieve.narrow_grades(ranked(t)), 10, 0.25).withColumn("parent_id", F.floor(F.col("chunk_id") / 4))
    p = t.chunks().select("collection", F.floor(F.col("chunk_id") / 4).alias("parent_id")).distinct().filter("parent_id % 5 <> 0")
    p = p.withColumn("parent_text", F.concat(F.lit("parent "), F.col("parent_id").cast("string")))
    return retrieve.expand_parents(hits, p)


@query(f"WITH {PARENT} SELECT query_id, chunk_id, CASE WHEN has THEN 'parent ' || parent_id ELSE substr(text, 1, 20) END AS text FROM exr")
def parent_expand(t: Tables) -> DataFrame:
    e = expanded(t)
    return e.select("query_id", "chunk_id", F.when(F.col("text").startswith("parent "), F.col("text")).otherwise(F.substring("text", 1, 20)).alias("text"))


TOKENS = "CAST(floor(length(text) * CAST(0.30 AS DOUBLE) + 0.5) AS INTEGER)"
PACKED = f"""{NARROW}, pc AS (SELECT query_id, chunk_id, final_score, text, tk AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY v, chunk_id) AS i
  FROM (SELECT *, -round(greatest(final_score, 1e-6) / tk, 9) AS v FROM (SELECT *, {TOKENS} AS tk FROM top10))),
st AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS took FROM (SELECT DISTINCT query_id FROM pc)
 UNION ALL SELECT s.query_id, p.i, CASE WHEN s.n < 4 AND s.used + p.tokens <= 2000 THEN s.used + p.tokens ELSE s.used END,
  CASE WHEN s.n < 4 AND s.used + p.tokens <= 2000 THEN s.n + 1 ELSE s.n END, s.n < 4 AND s.used + p.tokens <= 2000 FROM st s JOIN pc p ON p.query_id = s.query_id AND p.i = s.i + 1),
kept AS (SELECT p.query_id, p.chunk_id, p.tokens, p.final_score FROM pc p JOIN st s ON s.query_id = p.query_id AND s.i = p.i WHERE s.took),
alone AS (SELECT query_id, chunk_id, CAST(floor((CASE WHEN contains(cut, '.') THEN length(cut) - strpos(reverse(cut), '.') + 1 WHEN contains(cut, '!') THEN length(cut) - strpos(reverse(cut), '!') + 1
   WHEN contains(cut, '?') THEN length(cut) - strpos(reverse(cut), '?') + 1 ELSE length(cut) END) * CAST(0.30 AS DOUBLE) + 0.5) AS INTEGER) AS tokens, final_score
  FROM (SELECT *, substr(text, 1, 2000) AS cut FROM pc) WHERE query_id NOT IN (SELECT query_id FROM kept)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) = 1),
ev AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS seq FROM (SELECT * FROM kept UNION ALL SELECT * FROM alone))"""


def evidence(rows: DataFrame) -> DataFrame:
    return retrieve.pack_evidence(retrieve.best(retrieve.narrow_grades(rows), 10, 0.25))


@query(f"WITH RECURSIVE {PACKED} SELECT query_id, chunk_id, tokens, CAST(seq AS INTEGER) AS seq FROM ev")
def pack_evidence(t: Tables) -> DataFrame:
    return evidence(ranked(t)).select("query_id", "chunk_id", "tokens", "seq")


LABEL = "CASE WHEN doc_id % 9 = 0 THEN '来源' || seq ELSE source || ' · 第' || (1 + doc_id % 200) || '页' END"


def labelled(t: Tables, rows: DataFrame) -> DataFrame:
    none = F.col("doc_id") % 9 == 0
    meta = t.documents.select(
        F.col("doc_id").alias("chunk_id"), F.when(none, "").otherwise(F.col("source")).alias("title"), F.lit("").alias("chapter"),
        F.when(~none, 1 + F.col("doc_id") % 200).alias("page"),
    )
    return retrieve.cite(evidence(rows).join(meta, "chunk_id"))


@query(f"WITH RECURSIVE {PACKED} SELECT query_id, chunk_id, CAST(seq AS INTEGER) AS seq, {LABEL} AS label FROM ev JOIN documents ON doc_id = chunk_id")
def citations(t: Tables) -> DataFrame:
    return labelled(t, ranked(t)).select("query_id", "chunk_id", "seq", "label")


@query(f"""WITH RECURSIVE {PACKED}, b AS (SELECT query_id, max(query_coverage) AS c FROM ranked GROUP BY 1)
SELECT ev.query_id, chunk_id, CAST(seq AS INTEGER) AS seq, final_score, tokens, {LABEL} AS label, b.c < 0.28 AS refused
FROM ev JOIN documents ON doc_id = chunk_id JOIN b ON b.query_id = ev.query_id""")
def hybrid_pipeline(t: Tables) -> DataFrame:
    """Recall by words and vectors, fusion, floor, rerank, grade narrowing, packing, citations, refusal."""
    rows = ranked(t)
    out = retrieve.refusals(t.questions(), rows).select("query_id", "refused")
    return labelled(t, rows).join(out, "query_id").select("query_id", "chunk_id", "seq", "final_score", "tokens", "label", "refused")


@query("""WITH c AS (SELECT DISTINCT 'neb_' || source AS collection, CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'science' WHEN 1 THEN 'math' ELSE 'chinese' END AS subject,
  CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'physics' ELSE 'other' END AS discipline, CAST(CAST(substr(source, 4) AS INTEGER) % 4 AS VARCHAR) AS grade FROM documents),
q AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'science' WHEN 1 THEN 'math' ELSE 'history' END AS subject,
  CASE WHEN item_id % 2 = 0 THEN 'physics' ELSE 'none' END AS discipline, CAST(item_id % 4 AS VARCHAR) AS grade FROM benchmark),
j AS (SELECT q.query_id, c.collection, q.grade = c.grade AS same, q.discipline = c.discipline AS own, max(CAST(q.discipline = c.discipline AS INT)) OVER (PARTITION BY query_id) AS any_ FROM q JOIN c USING (subject))
SELECT query_id, collection, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN same THEN 0 ELSE 1 END, collection) AS INTEGER) AS pos FROM j WHERE any_ = 0 OR own""")
def route(t: Tables) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    pick = lambda k, names: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    c = t.documents.select("source").distinct().select(
        F.concat(F.lit("neb_"), "source").alias("collection"), pick(n, ("science", "math", "chinese")).alias("subject"),
        pick(n, ("physics", "other")).alias("discipline"), (n % 4).cast("string").alias("grade"),
    )
    i = F.col("query_id")
    q = t.questions().select(
        "query_id", pick(i, ("science", "math", "history")).alias("subject"), pick(i, ("physics", "none")).alias("discipline"), (i % 4).cast("string").alias("grade")
    )
    return routing.route(q, c)


@query("""SELECT DISTINCT name, (starts_with(name, 'neb_')) AND name <> 'neb_readme' AS allowed FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id = 1 THEN 'neb_readme' ELSE 'neb_' || source END AS name FROM documents)""")
def coll_allowed(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.col("source")).when(i == 1, "neb_readme").otherwise(F.concat(F.lit("neb_"), "source"))
    return t.documents.select(name.alias("name")).distinct().select("name", routing.allowed(F.col("name")).alias("allowed"))


ALIASES = "SELECT * FROM (VALUES ('Physics', 'science'), ('物理', 'science'), ('maths', 'math'), ('MATH', 'math')) AS t(alias, canonical)"
VALUES = "SELECT * FROM (VALUES (1, 'Physics'), (2, 'physics'), (3, '物理'), (4, 'Maths'), (5, 'Social Studies')) AS t(id, value)"


@query(f"""SELECT id, coalesce(e.canonical, f.canonical, replace(lower(trim(value)), ' ', '_')) AS canonical FROM ({VALUES}) v
LEFT JOIN ({ALIASES}) e ON e.alias = v.value LEFT JOIN (SELECT lower(alias) AS low, min(canonical) AS canonical FROM ({ALIASES}) GROUP BY 1) f ON f.low = lower(v.value)""")
def alias_lookup(t: Tables) -> DataFrame:
    return routing.lookup(t.values(VALUES), t.values(ALIASES)).select("id", "canonical")




BOOKS = """SELECT 'phys1' AS book_id, 1 AS rule_order, array(array('physics', '物理'), array('1', '一')) AS match_all, array('lab') AS exclude
UNION ALL SELECT 'phys', 2, array(array('physics', '物理')), array('draft') UNION ALL SELECT 'any', 3, array(array('book')), array('zz')"""
NAMES = "SELECT * FROM (VALUES ('Physics Book 1'), ('physics-lab 1'), ('物理 第一册'), ('draft physics'), ('book of maps'), ('none')) AS t(name)"


@query("SELECT * FROM (VALUES ('Physics Book 1','phys1'), ('physics-lab 1','phys'), ('物理 第一册','phys1'), ('draft physics',NULL), ('book of maps','any'), ('none',NULL)) AS t(name, book_id)")
def catalog_match(t: Tables) -> DataFrame:
    return routing.match_books(t.values(NAMES), t.values(BOOKS))


@query("""SELECT * FROM (VALUES ('textbooks/grade_10/x.pdf','10'), ('textbooks/11/x.pdf','11'), ('a/b/book 2019 vol 3.pdf','3'), ('p1_probe/x.pdf','unknown'), ('x/class_7_old/y.pdf','7'), ('z/plain.txt','unknown')) AS t(path, grade)""")
def grade_infer(t: Tables) -> DataFrame:
    """By explicit marks, numeric directories, then numbers of up to 12 in the name. Year digits come in pairs above 12 mostly."""
    rows = t.values("SELECT * FROM (VALUES ('textbooks/grade_10/x.pdf'), ('textbooks/11/x.pdf'), ('a/b/book 2019 vol 3.pdf'), ('p1_probe/x.pdf'), ('x/class_7_old/y.pdf'), ('z/plain.txt')) AS t(path)")
    return rows.select("path", routing.grade_of(F.col("path")).alias("grade"))


@query("""SELECT * FROM (VALUES (1, 1, '平抛运动是什么'), (1, 2, '自由落体是什么'), (2, 1, '物质的量浓度怎么算'), (3, 1, 'force vectors')) AS t(query_id, pos, variant)""")
def rewrite_variants(t: Tables) -> DataFrame:
    q = t.values("SELECT * FROM (VALUES (1, '平抛运动和自由落体有什么区别'), (2, '摩尔浓度怎么算'), (3, 'force arrows'), (4, 'plain')) AS t(query_id, text)")
    s = t.values("SELECT * FROM (VALUES ('摩尔浓度', '物质的量浓度', 0), ('arrows', 'vectors', 0)) AS t(term, synonym, ord)")
    return routing.variants(q, s)


ROUTED = """
asked AS (SELECT item_id AS query_id, 0 AS route, text FROM benchmark UNION ALL
 SELECT item_id, 1, replace(text, 'and', 'und') FROM benchmark WHERE contains(text, 'and') AND NOT contains(text, 'und')),
routed AS (SELECT b.item_id AS query_id, c.source AS collection FROM benchmark b JOIN (SELECT DISTINCT source FROM documents) c
 ON CAST(substr(c.source, 4) AS INTEGER) % 2 = b.item_id % 3)"""
ANSWER = BM25.replace("SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark", "SELECT DISTINCT query_id * 16 + route AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM asked") + """,
dn AS (SELECT q.vec_id AS query_id, d.source AS collection, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id CROSS JOIN embeddings v JOIN documents d ON d.doc_id = v.vec_id
 QUALIFY row_number() OVER (PARTITION BY q.vec_id, d.source ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 20),
routes AS (SELECT r.* FROM (SELECT query_id, 0 AS route, 'dense' AS kind, collection, chunk_id, score FROM dn
 UNION ALL SELECT query_id // 16, query_id % 16 + 1, 'bm25', collection, chunk_id, score FROM bm) r JOIN routed USING (query_id, collection)),""" + FUSED[FUSED.index("\nrk AS") :]
ANSWER += RANKED[RANKED.index(",\ncand AS") :].replace(
    f"round(len(list_intersect({G.format('query')}, {G.format('text')})) / len({G.format('query')}), 6) AS query_coverage",
    f"round(greatest(len(list_intersect({G.format('query')}, {G.format('text')})) / len({G.format('query')}), CASE WHEN contains(query, 'and') AND NOT contains(query, 'und') THEN len(list_intersect({G.format(chr(40) + 'replace(query, chr(97)||chr(110)||chr(100), chr(117)||chr(110)||chr(100))' + chr(41))}, {G.format('text')})) / len({G.format('replace(query, chr(97)||chr(110)||chr(100), chr(117)||chr(110)||chr(100))')}) ELSE 0 END), 6) AS query_coverage",
)
ANSWER += PARENT[len(RANKED) :]
ANSWER += PACKED[len(NARROW) :].replace("FROM (SELECT *, -round", "FROM (SELECT *, -round").replace("FROM top10)))", "FROM (SELECT * REPLACE (CASE WHEN has THEN ptext ELSE text END AS text) FROM (SELECT *, 'parent ' || repeat('word ', CAST(parent_id % 2000 AS INTEGER)) || 'end.' AS ptext FROM exr)))))")


@query(f"""WITH RECURSIVE {ROUTED}, {ANSWER}, b AS (SELECT ev.query_id, max(r.query_coverage) AS c FROM ev JOIN ranked r ON r.query_id = ev.query_id AND r.chunk_id = ev.chunk_id GROUP BY 1)
SELECT item_id AS query_id, coalesce(b.c, 0) < 0.28 AS refused, chunk_id, CAST(seq AS INTEGER) AS seq, tokens, final_score
FROM benchmark LEFT JOIN ev ON ev.query_id = item_id LEFT JOIN b ON b.query_id = item_id""")
def answer_pipeline(t: Tables) -> DataFrame:
    """Wordings, routing, recall per collection for each wording, fusion, rank, grades, parents, packing, refusal."""
    n, i = F.substring("source", 4, 9).cast("int"), F.col("query_id")
    names = lambda k, of: F.get(F.array(*[F.lit(x) for x in of]), (k % len(of)).cast("int"))
    collections = t.documents.select("source").distinct().select(
        F.col("source").alias("collection"), names(n, ("science", "math")).alias("subject"), F.lit("").alias("discipline"), F.lit("").alias("grade")
    )
    asked = asked_vectors(t)
    questions = t.questions().join(asked, "query_id", "left").select(
        "query_id", "text", names(i, ("science", "math", "history")).alias("subject"), F.lit("none").alias("discipline"), (1 + i % 3).cast("string").alias("grade"), "qvec"
    )
    kinds = F.array(*[F.lit(x) for x in ("body", "definition", "example", "other")])
    chunks = t.chunks().select(
        "chunk_id", "collection", "text", F.lit("web").alias("source"), F.lit("").alias("edition"), "grade", F.lit("").alias("grade_span"),
        F.get(kinds, (F.col("chunk_id") % 4).cast("int")).alias("content_type"), F.floor(F.col("chunk_id") / 4).alias("parent_id"),
    )
    parents = chunks.select("collection", "parent_id").distinct().filter("parent_id % 5 <> 0")
    made = F.concat(F.lit("parent "), F.repeat(F.lit("word "), (F.col("parent_id") % 2000).cast("int")), F.lit("end."))
    synonyms = t.values("SELECT 'and' AS term, 'und' AS synonym, 0 AS ord")
    out = answers.answer(questions, collections, chunks, vectors(t), parents.withColumn("parent_text", made), synonyms, floor=0.25)
    return out.select("query_id", "refused", "chunk_id", "seq", "tokens", "final_score")


@query("""SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(collection, '1') THEN 0 ELSE 1 END, rn) AS INTEGER) AS pos
FROM (WITH """ + BM25 + """ SELECT query_id, collection, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, collection, chunk_id) AS rn FROM bm WHERE score >= 0.35 AND rn <= 5)""")
def source_first(t: Tables) -> DataFrame:
    """Rows of the preferred collections first, both parts in their order."""
    b = retrieve.bm25(t.questions(), t.chunks(), 5).filter("score >= 0.35")
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "chunk_id"))
    first = F.when(F.col("collection").contains("1"), 0).otherwise(1)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(first, "rn"))
    return b.drop("rn").withColumn("rn", rn).select("query_id", "chunk_id", pos.alias("pos"))


@query("""SELECT doc_id, round(CAST(f AS DOUBLE) / n, 6) AS completeness FROM (SELECT doc_id, 7 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS f,
 9 + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS n FROM documents)""")
def meta_complete(t: Tables) -> DataFrame:
    """Filled over required fields: nine, and chapter and section where there is a section title."""
    i = F.col("doc_id")
    fields = [F.lit("x")] * 7 + [F.when(i % 2 == 0, "x"), F.when(i % 3 == 0, "x").otherwise("unknown")]
    have = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "0", "unknown"), 0).otherwise(1)
    titled = i % 5 == 0
    filled = sum((have(c) for c in fields), F.lit(0)) + F.when(titled, have(F.lit("chapter")) + have(F.lit(""))).otherwise(0)
    return t.documents.select("doc_id", F.round(filled.cast("double") / (9 + F.when(titled, 2).otherwise(0)), 6).alias("completeness"))
