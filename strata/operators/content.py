"""Content trees, learners' progress, noise phrases, diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.latex import ratio
from strata.functions.outline import content_concepts
from strata.functions.rules import NOISE_WORDS, contains_any, noise_likely, words
from strata.operators.route import small
from strata.sources.shared import materialise


def latest(rows: DataFrame, *keys: str, order: str = "load_seq") -> DataFrame:
    """The row of each key that was loaded last."""
    others = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r"))
    return g.select(*keys, "r.*").select(rows.columns)


def paths(nodes: DataFrame) -> DataFrame:
    """id, parent, depth and path (names from the root) of nodes (id, parent, name), however deep.

    One level after another is joined and written, until one is empty; a node below itself or below no root has no path.
    """
    level = materialise(nodes.filter("parent is null").select("id", "parent", F.lit(0).alias("depth"), F.array("name").alias("path")), "level")
    out = level
    while not level.isEmpty():
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"), (F.col("depth") + 1).alias("depth"))
        level = nodes.join(up, "parent").select("id", "parent", "depth", F.concat("above", F.array("name")).alias("path"))
        level = materialise(level, "level")
        out = out.unionByName(level)
    return out


def outline(contents: DataFrame) -> DataFrame:
    """One row for each concept of contents (subject, content as JSON): subject, ord, topic, path, name, summary, steps, questions."""
    return contents.select("subject", F.explode(content_concepts(F.col("content"))).alias("c")).select("subject", "c.*")


def find_concept(rows: DataFrame, subject: str, topic: str, name: str) -> DataFrame:
    """The first concept of that name in a topic of an outline; no row if there is none."""
    found = rows.filter((F.col("subject") == subject) & (F.col("topic") == topic) & (F.col("name") == name))
    return found.orderBy("ord").limit(1)


def find_question(rows: DataFrame, subject: str, topic: str, name: str, index: int) -> DataFrame:
    """question, answers, hints of the concept's question number index, from 0; no row beyond the last or below 0."""
    q = find_concept(rows, subject, topic, name).select(F.when(F.lit(index >= 0), F.get("questions", F.lit(max(index, 0)))).alias("q"))
    return q.filter("q is not null").select("q.*")


def concepts_at(rows: DataFrame, subject: str, topic: str, path: tuple[str, ...] = ()) -> DataFrame:
    """Concepts of a topic at a path of subtopics or below it."""
    here = rows.filter((F.col("subject") == subject) & (F.col("topic") == topic))
    return here.filter(F.slice("path", 1, len(path)) == F.array(*map(F.lit, path))) if path else here


def default_context(rows: DataFrame, fallback: str) -> DataFrame:
    """One row, text: the summary of the first concept beside a topic whose name has ``introduction`` in it, else the fallback."""
    found = rows.filter(F.lower("name").contains("introduction") & (F.size("path") == 0))
    return found.agg(F.coalesce(F.min_by("summary", F.struct("subject", "ord")), F.lit(fallback)).alias("text"))


def search(rows: DataFrame, asked: DataFrame, most: int = 3, similar: float = 0.6) -> DataFrame:
    """query_id, pos and the concept: the first most concepts of an outline, by subject and order, that match each question.

    A concept matches if a field of it (name, summary, a step, a question, an answer) has every word of the question or is similar
    to it. asked (query_id, text) is a stated set of at most 10 000 questions and goes to the concepts whole.
    """
    fields = F.concat(
        F.array("name", "summary"), "steps", F.flatten(F.transform("questions", lambda q: F.concat(F.array(q.question), q.answers)))
    )
    own = rows.select("subject", "ord", "topic", "name", "summary", F.transform(F.filter(fields, lambda f: f.isNotNull()), lambda f: F.lower(f)).alias("fields"))
    q = asked.select("query_id", F.lower("text").alias("q")).withColumn("words", F.filter(F.split("q", "\\s+"), lambda w: w != ""))
    j = own.join(small(q))
    each = j.select("query_id", "subject", "ord", "topic", "name", "summary", "q", "words", F.explode("fields").alias("f"))
    hit = F.forall("words", lambda w: F.col("f").contains(w)) | (ratio(F.col("q"), F.col("f")) > similar)
    found = each.filter(hit).groupBy("query_id", "subject", "ord", "topic", "name").agg(F.first("summary").alias("summary"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("subject", "ord"))
    return found.withColumn("pos", pos).filter(F.col("pos") <= most)


def browseable(tree: DataFrame, concepts: DataFrame) -> DataFrame:
    """id, label (A > B > C) and number of concepts at or below each node that has some. concepts: node."""
    each = concepts.join(tree.select(F.col("id").alias("node"), F.col("path").alias("full")), "node")
    prefixes = each.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("full")), lambda n: F.slice("full", F.lit(1), n))).alias("path"))
    n = prefixes.groupBy("path").agg(F.count("*").alias("n_concepts"))
    return tree.join(n, "path").select("id", F.array_join("path", " > ").alias("label"), "n_concepts")


def progress(attempts: DataFrame) -> DataFrame:
    """Per user, subject, concept: attempts, correct, and state: mastered (5 tries, 80 %), weak (5 tries, under half), else open.

    Rolled up to the subject and the user.
    """
    r = attempts.rollup("user_id", "subject", "concept").agg(F.count("*").alias("attempts"), F.sum("correct").cast("long").alias("correct"))
    share = F.col("correct") / F.col("attempts")
    state = F.when((F.col("attempts") >= 5) & (share >= 0.8), "mastered").when((F.col("attempts") >= 5) & (share < 0.5), "weak").otherwise("open")
    return r.withColumn("pct", F.round(share, 6)).withColumn("state", state)


def upsert(attempts: DataFrame, new: DataFrame) -> DataFrame:
    """Counters after new attempts: keys user_id, concept, question; attempts and correct add up."""
    keys = ["user_id", "concept", "question"]
    add = new.groupBy(*keys).agg(F.count("*").alias("attempts"), F.sum("correct").alias("correct"))
    both = attempts.select(*keys, "attempts", "correct").unionByName(add)
    return both.groupBy(*keys).agg(F.sum("attempts").cast("long").alias("attempts"), F.sum("correct").cast("long").alias("correct"))


def weak_questions(questions: DataFrame, counters: DataFrame) -> DataFrame:
    """Questions tried twice or more and never right."""
    return questions.join(counters, ["concept", "question"]).filter("attempts >= 2 and correct = 0")


def mine_phrases(logs: DataFrame, min_frequency: int = 10, min_confidence: float = 0.6, most: int = 100) -> DataFrame:
    """Noise phrases of two to four words in low-confidence logs (original, confidence): phrase, frequency, confidence.

    The report takes the most frequent phrases first, as many as asked for.
    """
    low = logs.filter("confidence < 0.7").select(F.lower("original").alias("o"))
    low = low.select("o", words(F.col("o")).alias("w"))
    def grams_of(n: int):
        made = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
        return F.when(F.size("w") >= n, made).otherwise(F.array().cast("array<string>"))

    grams = F.concat(*[grams_of(n) for n in (2, 3, 4)])
    rows = low.select("o", F.explode(F.filter(grams, lambda g: F.length(g) > 5)).alias("phrase"))
    counted = rows.groupBy("phrase").agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "phrase").limit(most)
    starts = rows.filter(F.col("o").startswith(F.col("phrase"))).groupBy("phrase").agg(F.countDistinct("o").alias("n_start"))
    j = counted.filter(F.col("frequency") >= min_frequency).filter(noise_likely(F.col("phrase"))).join(starts, "phrase", "left")
    score = (
        0.5 + F.when(F.col("frequency") > 50, 0.2).when(F.col("frequency") > 20, 0.1).otherwise(0.0)
        + F.when(F.coalesce("n_start", F.lit(0)) > 0.7 * F.col("frequency"), 0.15).otherwise(0.0)
        + F.when(contains_any(F.col("phrase"), NOISE_WORDS), 0.15).otherwise(0.0)
    )
    j = j.select("phrase", "frequency", F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))
    return j.filter(F.col("confidence") >= min_confidence)


STOP_WORDS = ("the", "and", "are", "for", "how", "what", "does", "with", "from", "that", "this", "was", "can", "you")


def match_diagrams(queries: DataFrame, diagrams: DataFrame) -> DataFrame:
    """The diagram whose keywords a question shares most: query_id, diagram_id, score (times 1.1 from two on, at most 1), at least 0.3."""
    found = F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("\\b[a-z]{3,}\\b"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS)), 1, 5)
    q = queries.select("query_id", found.alias("kw")).select("query_id", "kw", F.explode(F.array_distinct("kw")).alias("k"))
    d = diagrams.select("diagram_id", F.explode("keywords").alias("k"))
    hits = q.join(d, "k").groupBy("query_id", "diagram_id").agg(F.count("*").alias("n"), F.max(F.size("kw")).alias("of"))
    score = F.col("n") / F.col("of")
    hits = hits.withColumn("score", F.round(F.least(F.when(F.col("n") >= 2, score * 1.1).otherwise(score), F.lit(1.0)), 6))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "diagram_id"))
    return hits.filter("score >= 0.3").withColumn("rn", rn).filter("rn = 1").select("query_id", "diagram_id", "score")
