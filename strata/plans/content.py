"""Plans of content, progress, mining and diagrams. Regions and nations stand in for a tree, parts for its concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import outline
from strata.operators import content
from strata.plans.registry import query
from strata.sources.tables import Tables


def _nodes(t: Tables) -> DataFrame:
    regions = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nations = t.nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name")
    )
    suppliers = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.col("s_name").alias("name")
    )
    return regions.unionByName(nations).unionByName(suppliers)


TREE = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
tree AS (SELECT id, parent, 0 AS depth, [name] AS path FROM nodes WHERE parent IS NULL UNION ALL
 SELECT n.id, n.parent, t.depth + 1, list_append(t.path, n.name) FROM nodes n JOIN tree t ON n.parent = t.id)"""


@query(f"WITH RECURSIVE {TREE} SELECT id, parent, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path FROM tree")
def content_flatten(t: Tables) -> DataFrame:
    return content.paths(_nodes(t)).select("id", "parent", "depth", F.array_join("path", "/").alias("path"))


@query(f"""WITH RECURSIVE {TREE}, c AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 3 = 0)
SELECT t.id, array_to_string(t.path, ' > ') AS label, CAST(count(*) AS BIGINT) AS n_concepts FROM tree t JOIN (SELECT path AS full_ FROM c JOIN tree ON tree.id = node) x
 ON x.full_[1:len(t.path)] = t.path GROUP BY t.id, t.path""")
def browse_topics(t: Tables) -> DataFrame:
    concepts = t.supplier.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return content.browseable(content.paths(_nodes(t)), concepts)


@query("""SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2""")
def content_merge(t: Tables) -> DataFrame:
    """Later files win: the last order of a customer and priority."""
    return content.latest(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderpriority", order="o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'name' WHEN p_size > 45 THEN 'size' WHEN p_type NOT LIKE '%S%' THEN 'type' END AS rule FROM part
WHERE p_name IS NULL OR p_name = '' OR p_size > 45 OR p_type NOT LIKE '%S%'""")
def content_validate(t: Tables) -> DataFrame:
    """Rows that break a rule, with the first rule they break."""
    rule = F.when(F.coalesce("p_name", F.lit("")) == "", "name").when(F.col("p_size") > 45, "size").when(~F.col("p_type").contains("S"), "type")
    return t.part.select("p_partkey", rule.alias("rule")).filter("rule is not null")


def _contents(t: Tables) -> DataFrame:
    """Suppliers as concepts of nations (subtopics) of regions (topics), one JSON document for each region, with unknown keys."""
    c = F.struct(
        F.col("s_name").alias("name"), F.concat(F.lit("supplier of "), "n_name").alias("summary"), F.array(F.concat(F.lit("step "), F.col("s_suppkey").cast("string"))).alias("steps"),
        F.array(F.struct(F.concat(F.lit("who is "), "s_name").alias("question"), F.array("s_name").alias("acceptable_answers"), F.array(F.lit("a hint")).alias("hints"))).alias("questions"),
        F.col("s_suppkey").alias("code"),
    )
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.array_sort(F.collect_list(c)).alias("concepts"))
    n = s.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), "concepts"))).alias("subtopics"))
    r = t.region.join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    topic = F.struct(F.col("r_name").alias("name"), "subtopics", F.lit("x").alias("note"))
    made = F.to_json(F.struct(F.lower("r_name").alias("subject"), (F.col("r_regionkey") + 6).alias("grade"), F.array(topic).alias("topics")))
    return r.select(F.lower("r_name").alias("subject"), made.alias("content"))


OUTLINE = """SELECT lower(r_name) AS subject, r_name AS topic, n_name AS sub, s_name AS name, 'supplier of ' || n_name AS summary, s_suppkey,
 CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name, s_name) - 1 AS INTEGER) AS ord
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(f"SELECT subject, ord, topic, sub AS path, name, summary, 'step ' || s_suppkey AS steps, 'who is ' || name AS question FROM ({OUTLINE})")
def content_outline(t: Tables) -> DataFrame:
    """Concepts of nested JSON, in document order."""
    o = content.outline(_contents(t))
    return o.select("subject", "ord", "topic", F.array_join("path", "/").alias("path"), "name", "summary", F.array_join("steps", "/").alias("steps"), F.get("questions", F.lit(0))["question"].alias("question"))


@query(f"""SELECT subject, CAST(count(*) + 1 AS INTEGER) AS n_dropped, 0 AS n_errors, min('topics[0].subtopics[0].concepts[0].code') AS first_code FROM ({OUTLINE}) GROUP BY subject""")
def content_strip(t: Tables) -> DataFrame:
    """Unknown keys are stripped and told, the rest is checked."""
    c = _contents(t).select("subject", outline.checked_content(F.col("content")).alias("c"))
    first = F.get(F.filter("c.dropped", lambda x: x.endswith("code")), F.lit(0))
    return c.select("subject", F.size("c.dropped").alias("n_dropped"), F.size("c.errors").alias("n_errors"), first.alias("first_code"))


@query(f"""WITH o AS ({OUTLINE}), t AS (SELECT subject, topic, min(r_regionkey) + 6 AS grade FROM o JOIN region ON lower(r_name) = subject GROUP BY 1, 2)
SELECT t.subject, CAST(2 + 1 + (SELECT count(DISTINCT sub) + 6 * count(*) FROM o WHERE o.subject = t.subject) AS INTEGER) AS n_lines,
 'subject: ' || t.subject || chr(10) || 'grade: ' || grade || chr(10) || 'name: ' || topic AS head FROM t""")
def content_lines(t: Tables) -> DataFrame:
    """key: value lines of nested JSON: of a concept its name and summary, of a question itself, its answer and hint; six a concept."""
    c = _contents(t).select("subject", F.split(outline.content_lines(F.col("content")), "\n").alias("l"))
    return c.select("subject", (F.size("l") + F.size(F.filter("l", lambda x: x.startswith("question: ")))).alias("n_lines"), F.array_join(F.slice("l", 1, 3), "\n").alias("head"))


ASKED = "SELECT * FROM (VALUES (1, 'supplier japan'), (2, 'step 7'), (3, 'nothing like that at all'), (4, 'who is supplier#000000003')) AS t(query_id, text)"


@query()
def content_search(t: Tables) -> DataFrame:
    """The first three concepts of each question with every word of it in one field, or a field like it; similarity has no SQL."""
    return content.search(content.outline(_contents(t)), t.values(ASKED)).select("query_id", "pos", "subject", "name")


@query(f"SELECT subject, topic, sub, CAST(count(*) AS BIGINT) AS n, min(name) AS first FROM ({OUTLINE}) GROUP BY ALL HAVING sub IN ('FRANCE', 'JAPAN', 'CHINA')")
def content_at_path(t: Tables) -> DataFrame:
    """Concepts below three paths."""
    o, out = content.outline(_contents(t)), None
    for topic, nation in (("EUROPE", "FRANCE"), ("ASIA", "JAPAN"), ("ASIA", "CHINA")):
        here = content.concepts_at(o, topic.lower(), topic, (nation,))
        out = here if out is None else out.unionByName(here)
    return out.groupBy("subject", "topic", F.get("path", F.lit(0)).alias("sub")).agg(F.count("*").alias("n"), F.min("name").alias("first"))


@query("""SELECT p_partkey, trim(p_name) AS name, array_to_string(list_filter([trim(p_brand), trim(p_type)], lambda x: x <> ''), '|') AS steps FROM part WHERE trim(p_name) <> ''""")
def concepts_norm(t: Tables) -> DataFrame:
    """Concepts with a name only, steps without blanks, trimmed."""
    steps = F.filter(F.transform(F.array("p_brand", F.lit(" "), "p_type"), lambda s: F.trim(s)), lambda s: s != "")
    return t.part.filter("trim(p_name) <> ''").select("p_partkey", F.trim("p_name").alias("name"), F.array_join(steps, "|").alias("steps"))


A = "a AS (SELECT event_id, user_id, 's' || (user_id % 3) AS subject, event_type AS concept, event_id % 7 AS question, CAST(value > 250 AS INT) AS correct FROM events)"


@query(f"""WITH {A} SELECT user_id, subject, concept, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct, round(sum(correct) / count(*), 6) AS pct,
CASE WHEN count(*) >= 5 AND sum(correct) / count(*) >= 0.8 THEN 'mastered' WHEN count(*) >= 5 AND sum(correct) / count(*) < 0.5 THEN 'weak' ELSE 'open' END AS state
FROM a GROUP BY ROLLUP (user_id, subject, concept)""")
def progress_stats(t: Tables) -> DataFrame:
    return content.progress(t.attempts())


@query(f"WITH {A} SELECT user_id, concept, question, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(correct) AS BIGINT) AS correct FROM a GROUP BY 1, 2, 3")
def progress_upsert(t: Tables) -> DataFrame:
    a = t.attempts()
    old = a.filter("event_id % 2 = 0").groupBy("user_id", "concept", "question").agg(F.count("*").alias("attempts"), F.sum("correct").alias("correct"))
    return content.upsert(old, a.filter("event_id % 2 = 1"))


@query(f"WITH {A} SELECT user_id, concept, question FROM a GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND sum(correct) = 0")
def weak_questions(t: Tables) -> DataFrame:
    a = t.attempts()
    counters = a.groupBy("user_id", "concept", "question").agg(F.count("*").alias("attempts"), F.sum("correct").alias("correct"))
    return content.weak_questions(a.select("concept", "question").distinct(), counters).select("user_id", "concept", "question")


N = "event_id % 3"


@query("""WITH l AS (SELECT CASE event_id % 3 WHEN 0 THEN 'please tell me about ' WHEN 1 THEN 'can you explain ' ELSE 'so basically ' END || event_type AS o, (event_id % 10)::DOUBLE / 10 AS c FROM events),
w AS (SELECT o, string_split(o, ' ') AS w FROM l WHERE c < 0.7),
g AS (SELECT o, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT o, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) AS t(n) WHERE len(w) >= n)),
f AS (SELECT phrase, count(*) AS frequency, count(DISTINCT CASE WHEN starts_with(o, phrase) THEN o END) AS st FROM g WHERE length(phrase) > 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100),
s AS (SELECT phrase, CAST(frequency AS BIGINT) AS frequency, regexp_matches(phrase, 'please|can you|help me|tell me|like|basically|actually|just|really|bro|bruh|sir') AS ind,
 round(least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN frequency > 50 THEN 0.2 WHEN frequency > 20 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN st > 0.7 * frequency THEN 0.15 ELSE 0 END::DOUBLE
 + CASE WHEN regexp_matches(phrase, 'please|can you|help me|tell me|like|basically|actually|just|really|bro|bruh|sir') THEN 0.15 ELSE 0 END::DOUBLE), 6) AS confidence FROM f WHERE frequency >= 10)
SELECT phrase, frequency, confidence FROM s WHERE confidence >= 0.6 AND (ind OR regexp_matches(phrase, '^(can|could|would) you|^please|help me|with reference|according to|in brief'))""")
def ngram_mine(t: Tables) -> DataFrame:
    start = F.get(F.array(*[F.lit(x) for x in ("please tell me about ", "can you explain ", "so basically ")]), (F.col("event_id") % 3).cast("int"))
    logs = t.events.select(F.concat(start, "event_type").alias("original"), (F.col("event_id") % 10 / 10.0).alias("confidence"))
    return content.mine_phrases(logs)


DIAGRAMS = "SELECT 'd1' AS diagram_id, array('water', 'cycle', 'stages') AS keywords UNION ALL SELECT 'd2', array('photosynthesis', 'process') UNION ALL SELECT 'd3', array('cells')"




@query()
def diagram_match(t: Tables) -> DataFrame:
    from strata.plans.rules import QUESTIONS

    q = t.values(QUESTIONS).select(F.col("qid").alias("query_id"), F.col("q").alias("text"))
    return content.match_diagrams(q, t.values(DIAGRAMS))
