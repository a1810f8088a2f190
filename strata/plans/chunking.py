"""Plans of chunking, pages, formulas and fuzzy phrases. Capital words stand in for headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import latex as formulas
from strata.operators import chunk, govern
from strata.plans.registry import query
from strata.sources.tables import Tables


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
a AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  CAST(length(line) <= 40 AND regexp_matches(line, '^[A-Z]') AS INT) AS h FROM l),
s AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section,
  last_value(CASE WHEN h = 1 AND regexp_matches(line, '^[A-M]') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chapter FROM a)
SELECT doc_id AS chunk_id, CAST(section AS BIGINT) AS section, max(CASE WHEN h = 1 THEN trim(line) END) AS title, max(chapter) AS chapter, CAST(min(pos) AS BIGINT) AS start,
 CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section""")
def sections(t: Tables) -> DataFrame:
    return chunk.sections(t.chunks(), lambda x: (F.length(x) <= 40) & x.rlike("^[A-Z]"), lambda x: F.when(x.rlike("^[A-M]"), x))


@query("""WITH d AS (SELECT doc_id, ['例题 1 ', '课后作业 ', '图 3 装置 ', '速度的定义 ', '牛顿定律 ', '', 'ISBN 123 ', '1.1 位移' || chr(10) || '1.2 速度' || chr(10) || '1.3 力' || chr(10) || '第二章 能' || chr(10)][doc_id % 8 + 1] || CASE WHEN doc_id % 16 = 7 THEN '2.1 功' ELSE text END AS x FROM documents),
l AS (SELECT doc_id, x, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS ls FROM d)
SELECT doc_id AS id, CASE WHEN trim(x) = '' THEN 'body'
 WHEN len(ls) >= 5 AND len(list_filter(ls, lambda y: length(y) <= 24 AND NOT ends_with(y, '。') AND regexp_matches(y, '^(第\\s*[一二三四五六七八九十百零\\d]+\\s*[章节单元课篇]|\\d{1,2}(\\.\\d{1,2})*\\s*[.、]?\\s*\\S)'))) >= 0.6 * len(ls) THEN 'toc'
 WHEN length(x) < 300 AND contains(x, 'ISBN') THEN 'cover' WHEN contains(substr(x, 1, 80), '例题') THEN 'example' WHEN contains(substr(x, 1, 80), '课后作业') THEN 'exercise'
 WHEN regexp_matches(substr(x, 1, 80), '^\\s*(图|表)\\s*[\\d一二三四五六七八九十]') THEN 'figure_caption' WHEN contains(substr(x, 1, 300), '定义') THEN 'definition' WHEN contains(substr(x, 1, 300), '定律') THEN 'theorem' ELSE 'body' END AS content_type FROM l""")
def content_type(t: Tables) -> DataFrame:
    """Documents behind beginnings of several kinds, or a table of contents."""
    starts = ("例题 1 ", "课后作业 ", "图 3 装置 ", "速度的定义 ", "牛顿定律 ", "", "ISBN 123 ", "1.1 位移\n1.2 速度\n1.3 力\n第二章 能\n")
    start = F.get(F.array(*[F.lit(x) for x in starts]), (F.col("doc_id") % 8).cast("int"))
    made = F.concat(start, F.when(F.col("doc_id") % 16 == 7, "2.1 功").otherwise(F.col("text")))
    return t.documents.select("doc_id", made.alias("x")).select(F.col("doc_id").alias("id"), chunk.content_type(F.col("x"), F.lit(True)).alias("content_type"))


@query("""WITH m AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_linenumber * 100 - l_orderkey % 40 AS start FROM lineitem ),
o AS (SELECT DISTINCT l_orderkey AS doc, unnest([50, 100, 250, 900]) AS pos FROM lineitem),
f AS (SELECT doc, min(page) AS first_ FROM m GROUP BY 1)
SELECT o.doc, CAST(pos AS INTEGER) AS "at", CAST(coalesce(m.page, f.first_, 0) AS INTEGER) AS page
FROM o ASOF LEFT JOIN m ON o.doc = m.doc AND o.pos >= m.start LEFT JOIN f ON f.doc = o.doc""")
def page_asof(t: Tables) -> DataFrame:
    l = t.lineitem
    m = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") * 100 - F.col("l_orderkey") % 40).cast("int").alias("start"))
    o = l.select(F.col("l_orderkey").alias("doc")).distinct().select("doc", F.explode(F.array(*[F.lit(x) for x in (50, 100, 250, 900)])).alias("at"))
    return govern.page_of(m, o)


@query()
def chunk_parents(t: Tables) -> DataFrame:
    return chunk.parents(t.chunks())


@query()
def chunk_children(t: Tables) -> DataFrame:
    return chunk.children(t.chunks())


@query()
def sentences(t: Tables) -> DataFrame:
    return chunk.sentences(t.chunks())


@query()
def simple_chunk(t: Tables) -> DataFrame:
    return chunk.by_bytes(t.chunks())


@query()
def latex(t: Tables) -> DataFrame:
    """Whole texts with a formula before them, as plain text."""
    made = F.concat(F.lit("\\frac{"), F.col("doc_id").cast("string"), F.lit("}{\\sqrt{2}} \\times x_1^{2} "), "text")
    return t.documents.select("doc_id", formulas.clean_text(made).alias("plain"))


@query("""SELECT doc_id AS chunk_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_pages, text, CAST(length(text) - length(string_split(text, chr(10))[-1]) AS INTEGER) AS last_start FROM documents""")
def page_markers(t: Tables) -> DataFrame:
    """Page markers before every line, taken out again."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("[[PAGE:"), (i + 1).cast("string"), F.lit("]]"), x))
    marked = t.chunks().select("chunk_id", F.array_join(lines, "\n").alias("text"))
    return chunk.page_markers(marked).select("chunk_id", F.size("markers").alias("n_pages"), F.col("clean").alias("text"), F.element_at("markers", -1)["start"].alias("last_start"))


@query("""SELECT doc_id AS chunk_id, source AS title, trim(text, chr(32)) AS body FROM documents""")
def front_matter(t: Tables) -> DataFrame:
    fenced = t.chunks().select("chunk_id", F.concat(F.lit("---\ntitle: 'old'\ntitle: \""), "collection", F.lit("\"\n---"), "text").alias("text"))
    return chunk.front_matter(fenced).select("chunk_id", F.col("meta")["title"].alias("title"), "body")


@query()
def fuzzy(t: Tables) -> DataFrame:
    phrases = ("with reference to the figure above", "according to the passage", "explain in brief")
    q = F.concat(F.lit("acording to the passage "), "text")
    return t.benchmark.select("item_id", formulas.fuzzy_removed(phrases)(q).alias("clean"))


@query()
def grade_answer(t: Tables) -> DataFrame:
    """Assistant turns against the user turn before: right if equal but for case and ends, or of a similarity above 0.8."""
    a, b = F.lower(F.trim("q")), F.lower(F.trim("a"))
    return t.turns().select("conv_id", "turn", ((a == b) | (formulas.ratio(a, b) > 0.8)).alias("right"))
