"""Plans of the column rules: text measures, questions, answers, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import rules, text
from strata.plans.registry import query
from strata.sources.tables import Tables

U = "list_distinct(regexp_extract_all(lower({0}), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9_]+'))"
G = "list_distinct(regexp_extract_all(lower({0}), '[a-z][a-z0-9_]+'))"
TOK = "CAST(floor(length({0}) * CAST(0.30 AS DOUBLE) + 0.5) AS INTEGER)"
TURNS = """
turns AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
#: A literal question table, the same in both engines.
QUESTIONS = """
SELECT * FROM (VALUES
  (1, 'hey can you tell me what is DNA'), (2, 'Explain in brief the process of photosynthesis'), (3, 'WHY IS THE SKY BLUE'),
  (4, 'idk how u solve 2+2=4'), (5, 'difference between AC and DC??'), (6, 'hi'), (7, '  '), (8, 'thanks'), (9, 'sorry'),
  (10, 'ab'), (11, 'find the value of x in this equation please'), (12, 'what does osmosis mean'),
  (13, 'according to the passage, give reasons'), (14, '写一篇散文'), (15, '作文怎么写'), (16, 'describe the water cycle and its stages'),
  (17, 'so basically what happens when i just mix acids'), (18, 'compare cells'), (19, 'photosyntesis is is goood goooood stuff here'),
  (20, 'A) this is one of the options here')
) AS t(qid, q)"""


@query("""SELECT doc_id, CAST(len(list_distinct(u)) AS INTEGER) AS n_units, CAST(len(u) AS INTEGER) AS n_length
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]|[a-z0-9_]+') AS u FROM documents)""")
def units(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.units(F.col("text"))).alias("n_units"), text.unit_length(F.col("text")).alias("n_length"))


@query("SELECT doc_id, CAST(len(u) AS INTEGER) AS n, md5(array_to_string(u, ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]|[a-z0-9_]+') AS u FROM documents)")
def tokens(t: Tables) -> DataFrame:
    u = text.unit_list(F.col("text"))
    return t.documents.select("doc_id", F.size(u).alias("n"), F.md5(F.array_join(u, " ")).alias("tokens"))


@query(f"SELECT doc_id, {TOK.format('text')} AS est FROM documents")
def est_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("est"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, h)) / len(g) END, 6) AS coverage
FROM (SELECT conv_id, turn, {G.format('q')} AS g, {G.format('a')} AS h FROM turns)""")
def coverage(t: Tables) -> DataFrame:
    return t.turns().select("conv_id", "turn", F.round(text.overlap(text.bigrams(F.col("q")), text.bigrams(F.col("a"))), 6).alias("coverage"))


@query(f"""WITH {TURNS}, m AS (SELECT conv_id, turn, a, {U.format('q')} AS uq, {U.format('a')} AS ua,
  len(regexp_extract_all(lower(a), '[a-z0-9_]+')) AS n FROM turns)
SELECT conv_id, turn, CASE WHEN coalesce(a, '') = '' THEN 0.0 WHEN n < 5 THEN 0.3 ELSE round(
  0.40::DOUBLE * (CASE WHEN n BETWEEN 30 AND 200 THEN 1.0 WHEN n BETWEEN 15 AND 29 OR n BETWEEN 201 AND 300 THEN 0.7 ELSE 0.4 END)::DOUBLE
  + 0.25::DOUBLE * (len(list_intersect(uq, ua)) / greatest(len(uq), 1)) + 0.35::DOUBLE * 0.5::DOUBLE, 3) END::DOUBLE AS confidence FROM m""")
def confidence(t: Tables) -> DataFrame:
    return t.turns().select("conv_id", "turn", rules.confidence(F.col("a"), F.col("q"), F.lit(0.5)).alias("confidence"))


@query(f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN coalesce(a, '') = '' OR coalesce(q, '') = '' THEN 'no_context'
  WHEN len({U.format('a')}) < 10 THEN 'grounded'
  WHEN regexp_matches(lower(a), 'i don''t have that information|my knowledge cutoff|unrelated to the context|based on general knowledge|i couldn''t find|not mentioned in the context') THEN 'admitted'
  WHEN len({G.format('a')}) > 0 AND len(list_intersect({G.format('a')}, {G.format('q')})) / len({G.format('a')}) < 0.15 THEN 'weak_overlap'
  ELSE 'grounded' END AS status FROM turns""")
def grounding(t: Tables) -> DataFrame:
    return t.turns().select("conv_id", "turn", rules.grounding(F.col("a"), F.col("q")).alias("status"))


@query("""WITH a AS (SELECT doc_id, [CAST(x AS INTEGER) FOR x IN regexp_extract_all('see [' || (doc_id % 6) || '] and [' || (doc_id % 4) || '] end', '\\[(\\d{1,2})\\]', 1)] AS c FROM documents)
SELECT doc_id, CAST(len(c) AS INTEGER) AS n_cited, CAST(len(list_filter(c, lambda x: x BETWEEN 1 AND 3)) AS INTEGER) AS n_valid,
CAST(len(list_filter(c, lambda x: x < 1 OR x > 3)) AS INTEGER) AS n_out, round(len(list_filter(c, lambda x: x BETWEEN 1 AND 3)) / len(c), 6) AS accuracy FROM a""")
def cite_check(t: Tables) -> DataFrame:
    """Marks in answers against a table of three citations."""
    answer = F.concat(F.lit("see ["), (F.col("doc_id") % 6).cast("string"), F.lit("] and ["), (F.col("doc_id") % 4).cast("string"), F.lit("] end"))
    d = t.documents.select("doc_id", rules.citations_in(answer).alias("c"))
    valid = F.size(F.filter("c", lambda x: x.between(1, 3)))
    return d.select(
        "doc_id", F.size("c").alias("n_cited"), valid.alias("n_valid"), (F.size("c") - valid).alias("n_out"),
        F.when(F.size("c") > 0, F.round(valid / F.size("c"), 6)).alias("accuracy"),
    )


@query(f"""WITH q AS ({QUESTIONS}), s AS (SELECT qid, lower(trim(q)) AS s FROM q)
SELECT qid, CASE WHEN s = '' THEN 'empty' WHEN length(s) < 4 THEN 'short' WHEN s IN ('hi','hello','hey') THEN 'greeting'
 WHEN s IN ('thanks','thank you') THEN 'thanks' WHEN s IN ('sorry','my bad') THEN 'apology' END AS edge,
 regexp_matches(s, '[+=/*√^]|solve|calculate|equation') AS math FROM s""")
def edge_case(t: Tables) -> DataFrame:
    return t.values(QUESTIONS).select("qid", rules.edge_case(F.col("q")).alias("edge"), rules.is_math(F.col("q")).alias("math"))


@query(f"""WITH q AS ({QUESTIONS}) SELECT qid, q LIKE '%散文%' AS creation FROM q""")
def creation_refuse(t: Tables) -> DataFrame:
    return t.values(QUESTIONS).select("qid", rules.is_creation(F.col("q")).alias("creation"))


@query(f"""WITH q AS ({QUESTIONS}) SELECT qid, CASE WHEN regexp_matches(lower(q), '^why |what is the reason|what causes') THEN 'WHY'
 WHEN regexp_matches(lower(q), '^how |what is the process') THEN 'HOW' WHEN regexp_matches(lower(q), '^describe |^explain |what happens') THEN 'DESCRIBE'
 WHEN regexp_matches(lower(q), '^define |what does .+ mean') THEN 'DEFINE' WHEN regexp_matches(lower(q), 'difference between|compare |versus') THEN 'COMPARE'
 WHEN regexp_matches(lower(q), '^solve |^calculate |^find ') THEN 'SOLVE' ELSE 'DESCRIBE' END AS intent,
 CASE WHEN length(trim(q)) / greatest(length(q), 1) < 0.5 THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM q""")
def intent(t: Tables) -> DataFrame:
    q = F.col("q")
    return t.values(QUESTIONS).select("qid", rules.intent(q).alias("intent"), rules.normaliser_confidence(q, F.trim(q), F.lit(1)).alias("confidence"))


_SUB = "q"
for _p, _to in [(p, "") for p in rules.STARTERS] + list(rules.SLANG) + [(p, "") for p in (*rules.FILLERS, *rules.POLITE)]:
    _SUB = f"regexp_replace({_SUB}, '{_p}', '{_to}', 'gi')"
_SUB = f"trim(regexp_replace({_SUB}, '\\s+', ' ', 'g'))"
for _p in rules.EXAM_PHRASES:
    _SUB = f"regexp_replace({_SUB}, '{_p}', '', 'gi')"
_SUB = f"regexp_replace(trim(regexp_replace({_SUB}, '\\s+', ' ', 'g')), '^[,:;\\-\\s]+', '')"
for _p, _to in rules.ABBREVIATIONS:
    _SUB = f"regexp_replace({_SUB}, '{_p}', '{_to}', 'g')"


@query(f"""WITH q AS ({QUESTIONS}), a AS (SELECT qid, {_SUB} AS s FROM q),
b AS (SELECT qid, CASE WHEN upper(s) = s AND lower(s) <> s THEN upper(s[1:1]) || lower(s[2:]) ELSE s END AS s FROM a),
c AS (SELECT qid, upper(s[1:1]) || s[2:] AS s FROM b),
d AS (SELECT qid, CASE WHEN regexp_matches(lower(s), '^(what|why|how|when|where|who)') AND NOT suffix(s, '?') THEN regexp_replace(s, '[.!,;:]+$', '') || '?' ELSE s END AS s FROM c)
SELECT qid, regexp_replace(s, '\\?+', '?', 'g') AS clean FROM d""")
def normalize_q(t: Tables) -> DataFrame:
    return t.values(QUESTIONS).select("qid", rules.normalised(F.col("q")).alias("clean"))


@query()
def spell_gate(t: Tables) -> DataFrame:
    """RE2 has no back references, so the run of four equal characters has no SQL here."""
    return t.values(QUESTIONS).select("qid", rules.spell_gate(F.col("q")).alias("check"))


_CONTAINS = lambda ws: " OR ".join(f"contains(low, '{w}')" for w in ws)


@query(f"""WITH x AS (SELECT item_id, text, lower(trim(text)) AS low, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM benchmark)
SELECT item_id, CASE WHEN length(trim(text)) < 5 THEN false WHEN {_CONTAINS(rules.CHAT)} THEN false
 WHEN n < 4 AND NOT ({_CONTAINS(rules.TERMS)}) THEN false WHEN {_CONTAINS(rules.STUDY)} THEN true ELSE n > 10 END AS gate FROM x""")
def rag_gate(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", rules.wants_retrieval(F.col("text")).alias("gate"))


@query(f"""WITH {TURNS}, x AS (SELECT conv_id, turn, a, lower(a) AS ca,
  list_distinct(list_filter(string_split_regex(lower(q), '\\s+'), lambda w: length(w) > 3)) AS ws FROM turns),
y AS (SELECT *, list_filter(ws, lambda w: contains(ca, w)) AS f FROM x)
SELECT conv_id, turn, CASE WHEN length(trim(a)) < 20 THEN false ELSE len(f) >= 2 OR len(list_filter(f, lambda w: length(w) > 5)) > 0 END AS relevant FROM y""")
def rag_relevance(t: Tables) -> DataFrame:
    return t.turns().select("conv_id", "turn", rules.context_is_relevant(F.col("q"), F.col("a")).alias("relevant"))


@query(f"""WITH q AS ({QUESTIONS}), x AS (SELECT qid, q, lower(q) AS low FROM q)
SELECT qid, NOT regexp_matches(low, '\\b(solve|calculate|compute|evaluate)\\b|\\b(formula|equation|algebra)\\b|[+\\-*/=]{{2,}}')
 AND regexp_matches(low, '\\b(how|process|work|flow|step|stage|phase)\\b|\\b(structure|parts|components|hierarchy|layer)\\b|\\b(cycle|loop|path|sequence|order)\\b|\\b(compare|difference|relationship|types)\\b') AS attempt,
 ({_CONTAINS(rules.VISUAL)}) AND NOT ({_CONTAINS(rules.FACTUAL)}) AS show FROM x""")
def diagram_gate(t: Tables) -> DataFrame:
    q = F.col("q")
    answer = F.repeat(F.lit("word "), 30)
    return t.values(QUESTIONS).select(
        "qid", rules.may_have_diagram(q).alias("attempt"), rules.shows_diagram(q, answer, F.lit(0.5)).alias("show")
    )


@query("SELECT c_custkey, regexp_matches(n, '^[A-Za-z0-9_]{3,32}$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, '#', '_') ELSE c_name END AS n FROM customer)")
def valid_user(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", rules.valid_user(name).alias("valid"))


@query("""SELECT doc_id, CASE WHEN length(f) <= 200 THEN f WHEN m > 101 THEN c[1:m] ELSE c END AS cut FROM (
 SELECT doc_id, f, c, greatest(CASE WHEN contains(c, '.') THEN length(c) - instr(reverse(c), '.') + 1 ELSE 0 END,
  CASE WHEN contains(c, '?') THEN length(c) - instr(reverse(c), '?') + 1 ELSE 0 END) AS m FROM (
  SELECT doc_id, f, f[1:200] AS c FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)))""")
def truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.truncate(F.col("text"), 200).alias("cut"))


@query("""WITH p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS page, source, text FROM documents)
SELECT source, (page - 1) // 5 AS topic, min(page) AS first_page, max(page) AS last_page, CAST(sum(length(text)) AS BIGINT) AS chars,
 md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY page)) AS ids FROM p GROUP BY 1, 2""")
def page_groups(t: Tables) -> DataFrame:
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    p = t.documents.select("doc_id", "source", F.length("text").alias("n"), page.alias("page"))
    ids = F.array_sort(F.collect_list(F.struct("page", F.col("doc_id").cast("string").alias("d"))))
    return p.groupBy("source", F.floor((F.col("page") - 1) / 5).alias("topic")).agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("n").cast("long").alias("chars"),
        F.md5(F.array_join(F.transform(ids, lambda x: x.d), ",")).alias("ids"),
    )


@query("""SELECT event_id, CASE WHEN json_valid(c) THEN json_extract_string(c, '$.k') END AS k FROM (
 SELECT event_id, coalesce(nullif(regexp_extract(r, '```(?:json)?\\s*(\\{[^`]*\\})\\s*```', 1), ''), nullif(regexp_extract(r, '(?s)(\\{.*\\})', 1), '')) AS c FROM (
 SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x ```json' || chr(10) || props || chr(10) || '``` y' WHEN 1 THEN 'text ' || props || ' tail' ELSE 'no json' END AS r FROM events))""")
def json_extract(t: Tables) -> DataFrame:
    """The fenced JSON of an answer, or from its first brace to its last."""
    nl = F.lit("\n")
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x ```json"), nl, "props", nl, F.lit("``` y")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("text "), "props", F.lit(" tail"))).otherwise("no json")
    )
    found = F.coalesce(
        F.nullif(F.regexp_extract(raw, "```(?:json)?\\s*(\\{[^`]*\\})\\s*```", 1), F.lit("")),
        F.nullif(F.regexp_extract(raw, "(?s)(\\{.*\\})", 1), F.lit("")),
    )
    return t.events.select("event_id", F.get_json_object(found, "$.k").alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'raw line' ELSE 'v' || event_id END AS picked FROM events")
def jsonl_pick(t: Tables) -> DataFrame:
    """The text, content or question field of a JSON line; a bad line stays raw."""
    line = F.when(F.col("event_id") % 4 == 3, F.lit("raw line"))
    for i, field in enumerate(("text", "content", "question")):
        line = line.when(F.col("event_id") % 4 == i, F.concat(F.lit(f'{{"{field}": "v'), F.col("event_id").cast("string"), F.lit('"}')))
    d = t.events.select("event_id", line.alias("line"))
    pick = F.coalesce(*[F.get_json_object("line", f"$.{f}") for f in ("text", "content", "question")], F.col("line"))
    return d.select("event_id", pick.alias("picked"))


@query("""SELECT doc_id, '来源：' || source || CASE WHEN n > 2 THEN ' 等 ' || n || ' 本' ELSE '' END AS sources FROM (SELECT doc_id, source, doc_id % 5 AS n FROM documents)""")
def sources_fmt(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 5
    more = F.when(n > 2, F.concat(F.lit(" 等 "), n.cast("string"), F.lit(" 本"))).otherwise("")
    return t.documents.select("doc_id", F.concat(F.lit("来源："), "source", more).alias("sources"))


@query("""WITH p AS (SELECT source, length(trim(text)) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS pages FROM documents),
s AS (SELECT source, list_sort(list(n)) AS l FROM p WHERE r % greatest(1, pages // least(6, pages)) = 0 AND r // greatest(1, pages // least(6, pages)) < least(6, pages) GROUP BY source)
SELECT source, CASE WHEN l[len(l) // 2 + 1] >= 80 THEN 'text' ELSE 'scanned' END AS kind, CAST(l[len(l) // 2 + 1] AS BIGINT) AS median FROM s""")
def pdf_kind(t: Tables) -> DataFrame:
    """A file is text if the median of up to six evenly spaced pages has 80 characters. Documents stand in for pages."""
    w = Window.partitionBy("source")
    d = t.documents.select(
        "source", F.length(F.btrim("text", F.lit(" "))).alias("n"), (F.row_number().over(w.orderBy("doc_id")) - 1).alias("r"), F.count("*").over(w).alias("pages")
    )
    few = F.least(F.lit(6), F.col("pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("pages") / few))
    s = d.filter((F.col("r") % step == 0) & (F.floor(F.col("r") / step) < few)).groupBy("source").agg(F.sort_array(F.collect_list("n")).alias("l"))
    m = F.get("l", F.floor(F.size("l") / 2).cast("int"))
    return s.select("source", F.when(m >= 80, "text").otherwise("scanned").alias("kind"), m.cast("long").alias("median"))


@query("""SELECT doc_id, md5(lower(lang) || '|' || CAST(1 + doc_id % 3 AS VARCHAR) || '|' || lower(trim(text))) AS key FROM documents""")
def cache_key(t: Tables) -> DataFrame:
    grade = (1 + F.col("doc_id") % 3).cast("string")
    q = F.lower(F.btrim("text", F.lit(" ")))
    return t.documents.select("doc_id", F.md5(F.concat_ws("|", F.lower("lang"), grade, q)).alias("key"))


@query("""SELECT doc_id, 'Answer clearly and correctly.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'H' ELSE '' END || chr(10) || chr(10) || source || chr(10) || chr(10) || lang AS prompt FROM documents""")
def prompt(t: Tables) -> DataFrame:
    history = F.when(F.col("doc_id") % 2 == 0, F.lit("H"))
    return t.documents.select("doc_id", rules.prompt(F.col("lang"), F.col("source"), history).alias("prompt"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 > 3 THEN round(b * 0.85::DOUBLE, 3) ELSE b END AS adjusted FROM (
 SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN least(s, 0.4::DOUBLE) WHEN 1 THEN round(s * 0.7::DOUBLE, 3) ELSE s END AS b
 FROM (SELECT doc_id, (doc_id % 10)::DOUBLE / 10 AS s FROM documents))""")
def answer_adjust(t: Tables) -> DataFrame:
    score = (F.col("doc_id") % 10).cast("double") / 10
    status = F.element_at(F.array(F.lit("admitted"), F.lit("weak_overlap"), F.lit("grounded")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.documents.select("doc_id", rules.adjusted(score, status, F.when(F.col("doc_id") % 5 > 3, 1).otherwise(0)).alias("adjusted"))


@query(f"""SELECT conv_id, CAST(sum({TOK.format("q || a")}) AS INTEGER) AS history FROM (
 SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a
 FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')) WHERE r <= 3 GROUP BY conv_id""")
def history_tokens(t: Tables) -> DataFrame:
    """Tokens of the last three exchanges of a conversation."""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = t.turns().withColumn("r", r).filter("r <= 3")
    return last.groupBy("conv_id").agg(F.sum(rules.history_tokens(F.col("q"), F.col("a"))).cast("int").alias("history"))


@query("""SELECT doc_id, CAST(greatest(200, least(4096 - (300 + 40) - (doc_id % 50) * 70 - 768, 2000)) AS INTEGER) AS budget FROM documents""")
def budget(t: Tables) -> DataFrame:
    history = (F.col("doc_id") % 50) * 70
    return t.documents.select("doc_id", rules.budget(F.lit(300), history).cast("int").alias("budget"))


@query("""SELECT n_nationkey, 'neb_' || CASE WHEN n_regionkey = 1 THEN regexp_replace(lower(n_name), '[^a-zA-Z0-9._-]', '_', 'g') ELSE CASE n_regionkey WHEN 0 THEN 'math' ELSE 'chinese' END END
 || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '_grade_' || (n_nationkey % 4) END AS name FROM nation""")
def coll_name(t: Tables) -> DataFrame:
    subject = F.when(F.col("n_regionkey") == 0, "math").when(F.col("n_regionkey") == 1, "science").otherwise("chinese")
    grade = F.when(F.col("n_nationkey") % 4 == 0, "unknown").otherwise((F.col("n_nationkey") % 4).cast("string"))
    return t.nation.select("n_nationkey", rules.collection_name(subject, grade, F.col("n_name")).alias("name"))


@query("""WITH t AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
s AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS q, list_distinct(regexp_extract_all(lower(a), '[a-z0-9_]+')) AS a FROM t)
SELECT conv_id, turn, CASE WHEN len(a) < 5 THEN 0.3 ELSE round(least(1.0, 0.5 + 0.5 * len(list_intersect(q, a)) / greatest(1, len(q))), 6) END::DOUBLE AS confidence FROM s""")
def confidence(t: Tables) -> DataFrame:
    return t.turns().select("conv_id", "turn", F.round(rules.confidence(F.col("a"), F.col("q")), 6).alias("confidence"))


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(trim('a: ' || text || ' Practice: more'), '^(Q:|A:)\\s*', '', 'i')) AS x FROM conversations),
m AS (SELECT conv_id, turn, trim(regexp_replace(split_part(regexp_replace(x, '\\n(Q:|A:)\\s*', chr(10), 'gi'), 'Practice:', 1), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM c)
SELECT conv_id, turn, CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?]$') THEN x || '.' ELSE x END AS answer FROM m""")
def answer_clean(t: Tables) -> DataFrame:
    made = F.concat(F.lit("a: "), "text", F.lit(" Practice: more"))
    return t.conversations.select("conv_id", "turn", rules.cleaned_answer(made).alias("answer"))


@query("""SELECT p_partkey, CASE WHEN contains(x, 'dna') THEN 'dna' WHEN contains(x, 'gene') THEN 'dna' WHEN contains(x, 'triangle') THEN 'triangle_right' WHEN contains(x, 'graph') THEN 'coordinate_plane' END AS diagram
FROM (SELECT p_partkey, lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' Triangle of a graph' WHEN 1 THEN ' DNA' WHEN 2 THEN ' a graph' WHEN 3 THEN ' generic' ELSE '' END) AS x FROM part)""")
def diagram_key(t: Tables) -> DataFrame:
    from strata.operators import route

    tails = F.get(F.array(*[F.lit(x) for x in (" Triangle of a graph", " DNA", " a graph", " generic", "")]), (F.col("p_partkey") % 5).cast("int"))
    return t.part.select("p_partkey", route.diagram_key(F.concat("p_name", tails)).alias("diagram"))
