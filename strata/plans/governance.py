"""Plans of governance, sinks and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import text
from strata.operators import govern, package
from strata.plans.registry import query
from strata.sources.shared import materialise
from strata.sources.tables import Tables

META = """
SELECT * FROM (VALUES (1, 'parent', 'body', NULL), (2, 'child', 'toc', NULL), (3, 'child', 'cover', 'active'), (4, 'child', NULL, 'archived'),
 (5, NULL, NULL, NULL), (6, 'child', 'body', 'active'), (7, 'parent', NULL, 'archived'), (8, '', '', '')) AS t(id, doc_type, content_type, status)"""
CLAIMS = """
SELECT * FROM (VALUES ('g', 1, 'height', '10'), ('g', 2, 'height', '12'), ('g', 3, 'mass', '5'), ('h', 4, 'mass', '5'), ('h', 5, 'mass', '5'),
 ('k', 6, 'age', '3'), ('k', 6, 'age', '4'), ('m', 7, 'age', '3'), ('m', 8, 'age', '4'), ('m', 9, 'age', '4')) AS t(concept_key, chunk_id, field, value)"""


@query(f"SELECT id FROM ({META}) WHERE coalesce(doc_type,'') <> 'parent' AND coalesce(content_type,'') NOT IN ('toc','cover') AND coalesce(status,'') <> 'archived'")
def gov_filter(t: Tables) -> DataFrame:
    return t.values(META).filter(govern.retrievable(F.col("doc_type"), F.col("content_type"), F.col("status"))).select("id")


@query("""WITH h AS (SELECT doc_id, text, sha256(regexp_replace(text, '[\\s\\x{3000}]+', '', 'g')) AS h, regexp_replace(text, '[\\s\\x{3000}]+', '', 'g') = '' AS e FROM documents),
f AS (SELECT doc_id, e, min(doc_id) OVER (PARTITION BY h) AS f FROM h)
SELECT doc_id AS chunk_id, CASE WHEN f <> doc_id AND NOT e THEN f END AS dup_of, CASE WHEN e THEN 'empty' WHEN f <> doc_id THEN 'exact' END AS dup_reason FROM f""")
def exact_dedup(t: Tables) -> DataFrame:
    return govern.exact_duplicates(t.chunks()).select("chunk_id", "dup_of", "dup_reason")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.35""")
def semantic_pairs(t: Tables) -> DataFrame:
    return govern.similar_pairs(t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), 0.35)


@query()
def semantic_dedup(t: Tables) -> DataFrame:
    """Greedy removals are sequential: no SQL."""
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 17).alias("n"))
    pairs = materialise(govern.similar_pairs(v.select("chunk_id", "vec"), 0.35), "pairs")
    return govern.greedy_removals(pairs, v.select("chunk_id", "n"))


@query(f"""SELECT concept_key, field, CAST(count(DISTINCT value) AS BIGINT) AS n_values, CAST(count(DISTINCT chunk_id) AS BIGINT) AS n_chunks,
 array_to_string(list_sort(list(DISTINCT value)), ',') AS vals FROM ({CLAIMS}) GROUP BY 1, 2 HAVING count(DISTINCT value) > 1 AND count(DISTINCT chunk_id) > 1""")
def conflict_rules(t: Tables) -> DataFrame:
    c = govern.conflicting(t.values(CLAIMS))
    return c.select("concept_key", "field", "n_values", "n_chunks", F.array_join("values", ",").alias("vals"))


@query("""WITH d AS (SELECT doc_id, source AS concept_key, '高度为' || length(text) || '.5米，质量约 ' || (doc_id % 3) || ' 千克' AS text FROM documents),
c AS (SELECT concept_key, doc_id, '高度' AS field, length(d.text) AS x, regexp_extract(text, '高度为([0-9.]+)', 1) AS value FROM d UNION ALL SELECT concept_key, doc_id, '质量', 0, regexp_extract(text, '质量约 ([0-9]+)', 1) FROM d)
SELECT concept_key, field, CAST(count(DISTINCT value) AS BIGINT) AS n_values, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_chunks FROM c GROUP BY 1, 2 HAVING count(DISTINCT value) > 1 AND count(DISTINCT doc_id) > 1""")
def conflicts(t: Tables) -> DataFrame:
    """Claims found in texts that state the length and number of each document, by source."""
    i = F.col("doc_id")
    made = F.concat(F.lit("高度为"), F.length("text").cast("string"), F.lit(".5米，质量约 "), (i % 3).cast("string"), F.lit(" 千克"))
    c = govern.conflicts(t.documents.select(i.alias("chunk_id"), F.col("source").alias("concept_key"), made.alias("text")))
    return c.select("concept_key", "field", "n_values", "n_chunks")


@query("SELECT 1 AS id, '高度' AS concept, '10.5' AS value UNION ALL SELECT 2, '引力常量', '6.67e-11' UNION ALL SELECT 3, '光速约', '3e-8'")
def num_claims(t: Tables) -> DataFrame:
    rows = t.values("SELECT * FROM (VALUES (1, '高度为10.5米'), (2, '引力常量是6.67×10⁻11'), (3, '光速约为3e8')) AS t(id, x)")
    return rows.select("id", F.explode(text.numeric_claims(F.col("x"))).alias("c")).select("id", "c.concept", "c.value")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id AS chunk_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^[\\s\\-.]{0,6}\\d{1,4}[\\s\\-.]{0,6}$') THEN 'page'
 WHEN regexp_matches(trim(line), '^\\s*[(]?\\s*\\d{1,3}\\s*[).]?\\s*$') THEN 'ordinal' ELSE 'keep' END AS verdict FROM l""")
def clean_lines(t: Tables) -> DataFrame:
    return govern.lines(t.chunks()).select("chunk_id", "line_no", "verdict")


@query()
def clean_chunk(t: Tables) -> DataFrame:
    return govern.clean(t.chunks())


@query("""SELECT doc_id, text AS fixed, regexp_matches(text, '[abcxyzABC]') AS issue FROM documents""")
def glyph_fix(t: Tables) -> DataFrame:
    """Letters of every text are misread glyphs first; what comes back is the text."""
    misread = F.translate("text", "abcxyzABC", "犪犫犮狓狔狕犃犅犆")
    return t.documents.select("doc_id", text.fix_glyphs(misread).alias("fixed"), text.has_glyph_issue(misread).alias("issue"))


@query("""SELECT c, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '[éèêçñóäöüß]')) AS c FROM documents) GROUP BY c""")
def glyph_stats(t: Tables) -> DataFrame:
    """Counts of mapped characters; accented letters stand in for misread glyphs. Counted in each row before the shuffle."""
    letters = "éèêçñóäöüß"
    found = F.array(*[
        F.struct(F.lit(x).alias("c"), (F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))).cast("long").alias("n")) for x in letters
    ])
    rows = t.documents.select(F.explode(found).alias("x")).filter("x.n > 0")
    return rows.groupBy("x.c").agg(F.sum("x.n").alias("n"))


@query("""SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source, lang""")
def type_hist(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(source, '(all)') AS collection, CAST(count(*) FILTER (doc_id % 4 = 0) AS BIGINT) AS parents, CAST(count(*) FILTER (doc_id % 4 <> 0) AS BIGINT) AS children
FROM documents GROUP BY ROLLUP (source)""")
def index_summary(t: Tables) -> DataFrame:
    d = t.documents.rollup("source").agg(F.count_if(F.col("doc_id") % 4 == 0).alias("parents"), F.count_if(F.col("doc_id") % 4 != 0).alias("children"))
    return d.select(F.coalesce("source", F.lit("(all)")).alias("collection"), "parents", "children")


@query("""SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (embedding IS NULL) AS BIGINT) AS nulls, CAST(count(*) FILTER (len(embedding) <> 64) AS BIGINT) AS wrong FROM embeddings GROUP BY label""")
def index_health(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("embedding").isNull()).alias("nulls"), F.count_if(F.size("embedding") != 64).alias("wrong")
    )


@query("""SELECT doc_id, v FROM (SELECT doc_id, 1 AS v, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 211 = 0)
 UNION ALL SELECT doc_id, 2 AS v, source FROM documents WHERE doc_id % 7 = 0)""")
def upsert_replace(t: Tables) -> DataFrame:
    """Sources that an update names lose their old rows; the update is another set of rows."""
    d = t.documents.select("doc_id", "source")
    named = d.filter("doc_id % 211 = 0").select("source")
    old = govern.replace_rows(d.withColumn("v", F.lit(1)), named.select(F.lit(None).cast("long").alias("doc_id"), "source", F.lit(0).alias("v")), "source")
    return old.filter("v = 1").unionByName(d.filter("doc_id % 7 = 0").withColumn("v", F.lit(2))).select("doc_id", "v")


@query()
def dedupe(t: Tables) -> DataFrame:
    """Exact and semantic duplicates within a kind, each with its reason; greedy removal has no SQL."""
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    d = t.documents.select("doc_id", "text", F.col("lang").alias("doc_type")).join(v, "doc_id", "left").withColumnRenamed("doc_id", "chunk_id")
    kept, dropped = govern.dedupe(d, 0.35)
    return dropped.select("chunk_id", "dup_reason", "dup_of").unionByName(kept.select("chunk_id", F.lit("kept").alias("dup_reason"), F.lit(None).cast("long").alias("dup_of")))


@query()
def pack_compressed(t: Tables) -> DataFrame:
    """The cap counts compressed bytes; zlib has no SQL."""
    return package.capped(package.compressed(t.documents), 60000, "compressed_size").select("package_id", "idx", "compressed_size", "upto")


@query("""WITH r AS (SELECT source, doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS fine FROM documents)
SELECT source AS package_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (fine) AS BIGINT) AS ok, round(count(*) FILTER (fine) / count(*), 6) AS success FROM r GROUP BY ROLLUP (source)""")
def sync_report(t: Tables) -> DataFrame:
    p = package.chunks(t.documents)
    have = p.filter("idx % 5 <> 0").select("idx", F.when(F.col("idx") % 11 == 0, "bad").otherwise(F.col("hash")).alias("got"))
    states = package.validate(p, have).join(p.select("idx", "package_id"), "idx")
    return package.report(states)


PKG = "SELECT source AS package_id, doc_id AS idx, octet_length(encode(text)) AS size, sha256(text) AS hash FROM documents"


@query(f"""SELECT package_id, idx, upto FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY package_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ({PKG})) WHERE upto <= 60000""")
def pack_cap(t: Tables) -> DataFrame:
    return package.capped(package.chunks(t.documents), 60000).select("package_id", "idx", "upto")


@query(f"SELECT package_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(size) AS BIGINT) AS total FROM ({PKG}) GROUP BY 1")
def pkg_catalog(t: Tables) -> DataFrame:
    return package.catalog(package.chunks(t.documents))


@query(f"""WITH p AS ({PKG}), have AS (SELECT idx, CASE WHEN idx % 11 = 0 THEN 'bad' ELSE hash END AS got FROM p WHERE idx % 5 <> 0)
SELECT p.idx, CASE WHEN h.idx IS NULL THEN 'missing' WHEN h.got <> p.hash THEN 'mismatch' ELSE 'ok' END AS state FROM p LEFT JOIN have h ON p.idx = h.idx""")
def pkg_validate(t: Tables) -> DataFrame:
    p = package.chunks(t.documents)
    have = p.filter("idx % 5 <> 0").select("idx", F.when(F.col("idx") % 11 == 0, "bad").otherwise(F.col("hash")).alias("got"))
    return package.validate(p, have)


@query("SELECT doc_id AS idx, doc_id % 13 <> 0 AS ok FROM documents")
def pkg_verify(t: Tables) -> DataFrame:
    """Payload hashes against a manifest in which every 13th is wrong."""
    p = package.chunks(t.documents)
    payload = t.documents.select(F.col("doc_id").alias("idx"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    told = p.select("idx", F.when(F.col("idx") % 13 == 0, "bad").otherwise(F.col("hash")).alias("hash"))
    return told.join(payload, "idx").select("idx", (F.col("own") == F.col("hash")).alias("ok"))


@query(f"SELECT DISTINCT hash FROM ({PKG}) WHERE hash NOT IN (SELECT hash FROM ({PKG}) WHERE idx % 3 = 0)")
def sync_diff(t: Tables) -> DataFrame:
    p = package.chunks(t.documents)
    return package.missing(p, p.filter("idx % 3 = 0"))


