"""Cases the tables do not hold: Han text, headings, metadata, sequences."""

import json
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import latex, outline, register, rules, text
from strata.operators import chunk, content, evaluate, govern, lookup, package, retrieve, route
from strata.plans import evaluation
from strata.sources import dims, files
from strata.sources.tables import Tables
from strata.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_text_measures(spark):
    assert set(one(spark, text.bigrams(F.col("a")), a="向心力是合力 Big ab1 x")) == {"向心", "心力", "力是", "是合", "合力", "big", "ab1"}
    assert one(spark, text.unit_length(F.col("a")), a="向心力是合力") == 6
    assert len(one(spark, text.units(F.col("a")), a="向心力是合力")) == 5
    assert one(spark, text.estimate_tokens(F.col("a")), a="向心力abcdefghij") == 6
    assert one(spark, text.overlap(text.bigrams(F.col("a")), text.bigrams(F.col("b"))), a="12 3", b="x") == 1.0
    assert one(spark, text.squeezed(F.col("a")), a="a 　b\n c") == "abc"


def test_glyphs_are_mapped_noise_goes_and_other_text_stays(spark):
    fix = text.fix_glyphs(F.col("a"))
    assert one(spark, fix, a="向量犪犫槡２") == "向量ab√２∀"
    assert one(spark, fix, a="燃烧烄") == "燃烧"
    assert one(spark, fix, a="\\Delta狓") == "\\Delta x"
    assert one(spark, fix, a="普通文字") == "普通文字"


@pytest.mark.parametrize(
    "given,plain",
    [
        ("\\frac{1}{\\sqrt{2}}", "(1)/(√(2))"), ("$a \\times b$", "a × b"), ("no formula", "no formula"), ("x^{2}", "x^{2}"), ("$x^{2}$", "x²"),
        ("\\frac{\\Delta y}{\\Delta x}", "(Δy)/(Δx)"), ("\\sqrt[3]{V}", "3√(V)"), ("\\alpha \\in (0, \\pi/2)", "α ∈ (0, π/2)"), ("$x_1 + x_2$", "x₁ + x₂"),
        ("\\lim_{\\Delta x \\to 0} \\frac{\\Delta y}{\\Delta x}", "lim(Δx → 0) (Δy)/(Δx)"), ("\\vec{AB} \\begin{cases}a\\end{cases}", "AB→ a"),
        ("\\sum_{i=1}^{n} x", "∑ᵢ₌₁ⁿ x"), ("\\frac{\\frac{1}{2}}{3}", "((1)/(2))/(3)"), ("\\left(\\frac{a}{b}\\right)", "((a)/(b))"), ("下划线_和", "下划线_和"),
        ("x^{\\frac{1}{2}}", "x^((1)/(2))"), ("a \\\\ b & c", "a\nb c"), ("\\foo{bar}", "foo{bar}"), ("\\text{m} \\frac{1", "m (1)/()"), ("", ""),
    ],
)
def test_latex(given, plain):
    assert latex.plain(given) == plain
    assert latex.plain(plain) == plain


def test_latex_of_hostile_texts_is_linear():
    for text_ in ("{" * 100_000 + "\\", "\\frac{" * 20_000, "\\sqrt[" * 20_000, "^{" * 50_000 + "$", "a_" * 50_000 + "$", "\\[" * 50_000):
        began = time.time()
        latex.plain(text_)
        assert time.time() - began < 2


def test_clean_text_keeps_commands_apart_from_glyphs(spark):
    clean = latex.clean_text(F.col("a"))
    assert one(spark, clean, a="\\Delta狓 \\to 0") == "Δx → 0"
    raw = "如果Δ狓→0时\n\\[\n\\text{狔}' = \\lim_{\\Delta狓 \\to 0} \\frac{\\Delta \\text{狔}}{\\Delta \\text{狓}}\n\\]"
    got = one(spark, clean, a=raw)
    assert "Δx→0" in got and "y' = lim(" in got and not set("狓狔\\{}") & set(got) and one(spark, clean, a=got) == got


def test_fuzzy_phrase():
    i, score = latex.best_window("please acording to the passage say", "according to the passage")
    assert i == 1 and score > 0.9


def test_rules(spark):
    assert one(spark, rules.is_creation(F.col("a")), a="帮我写一篇800字的散文") is True
    assert one(spark, rules.is_creation(F.col("a")), a="怎么写议论文") is False
    assert one(spark, rules.edge_case(F.col("a")), a=" Hello ") == "greeting"
    assert one(spark, rules.edge_case(F.col("a")), a=None) == "empty"
    assert one(spark, rules.spell_gate(F.col("a")), a="this is a goooood day") is True
    assert one(spark, rules.normalised(F.col("a")), a="hey what is  EMF") == "What is electromotive force?"
    assert one(spark, rules.normalised(F.col("a"), ("in exam style",)), a="What happens when the switch is open, In Exam Style") == "What happens in a electric circuit when the switch is open?"
    assert one(spark, rules.normalised(F.col("a")), a="what happens if a circuit opens in an electric circuit") == "What happens if a circuit opens in an electric circuit?"
    assert one(spark, rules.grounding(F.col("a"), F.col("b")), a="我推测这个问题的答案其实是另外一个完全不同的东西", b="课文") == "admitted"


def test_missing_metadata_passes_the_filter(spark):
    df = spark.sql("select * from values (1, null, null, null), (2, 'parent', null, null), (3, 'child', 'toc', null), (4, 'child', 'body', 'archived') t(id, d, c, s)")
    assert [r.id for r in df.filter(govern.retrievable(F.col("d"), F.col("c"), F.col("s"))).collect()] == [1]


def test_cleaning_gives_a_reason_for_every_change(spark):
    long = "正文" * 30
    rows = [(1, f"第二章 运动的描述\n{long}\n第二章 运动的描述\n12\n图 3-1\n(2)"), (2, long), (3, "短"), (4, f"ISBN 9787107123456\n{'版权所有 翻印必究'}")]
    got = {r.chunk_id: r for r in govern.clean(spark.createDataFrame(rows, "chunk_id long, text string")).collect()}
    assert got[1].text == f"第二章 运动的描述\n{long}" and got[1].reason == "lines:1p/1h/1f/1o/0c"
    assert got[2].text == long and got[2].reason == ""
    assert got[3].reason == "too_short" and got[4].reason == "copyright"


def test_exact_duplicates_keep_the_first_and_conserve_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, " "), (4, "c")], "chunk_id long, text string")
    got = {r.chunk_id: (r.dup_of, r.dup_reason) for r in govern.exact_duplicates(d).collect()}
    assert got == {1: (None, None), 2: (1, "exact"), 3: (None, "empty"), 4: (None, None)}


def test_greedy_removals_follow_the_sequence(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.98), (3, 4, 0.97)], "a long, b long, cosine double")
    n = spark.createDataFrame([(1, 9), (2, 5), (3, 5), (4, 5)], "chunk_id long, n long")
    assert sorted((r.loser, r.winner) for r in govern.greedy_removals(pairs, n).collect()) == [(2, 1), (4, 3)]


def test_fusion_rewards_agreement_and_ignores_scale(spark):
    rows = [(1, 0, "dense", "c", 1, 0.9), (1, 0, "dense", "c", 2, 0.8), (1, 1, "bm25", "c", 2, 5.0), (1, 1, "bm25", "d", 2, 4.0)]
    kind = "query_id int, route int, kind string, collection string, chunk_id int, score double"
    order = lambda rs: [(r.collection, r.chunk_id) for r in retrieve.fuse(spark.createDataFrame(rs, kind)).orderBy("pos").collect()]
    assert order(rows)[0] == ("c", 2) and len(order(rows)) == 3
    assert order(rows) == order([(*r[:5], r[5] * 1000) for r in rows])


def test_packing_skips_what_does_not_fit_and_is_never_empty(spark):
    rows = [(1, 1, "x" * 4000, 0.9), (1, 2, "y" * 300, 0.5), (1, 3, "z" * 300, 0.4), (2, 4, "w" * 40000, 0.3)]
    got = retrieve.pack_evidence(spark.createDataFrame(rows, "query_id int, chunk_id int, text string, final_score double"), 1000).collect()
    assert sorted((r.query_id, r.chunk_id, r.tokens) for r in got) == [(1, 2, 90), (1, 3, 90), (2, 4, 300)]


def test_pages(spark):
    m = spark.createDataFrame([("a", 10, 1), ("a", 50, 2)], "doc string, start int, page int")
    o = spark.createDataFrame([("a", 0), ("a", 10), ("a", 49), ("a", 50), ("b", 5)], "doc string, at int")
    assert sorted((r.doc, r.at, r.page) for r in govern.page_of(m, o).collect()) == [("a", 0, 1), ("a", 10, 1), ("a", 49, 1), ("a", 50, 2), ("b", 5, 0)]


def simple_pieces(t, size, overlap, least, ends, regions):
    """The chunker's rules over all places, one by one."""
    inside = lambda p: next(((a, b) for a, b in regions if a <= p <= b), None)
    if len(t) < least:
        return [(0, len(t))]
    out, at = [], 0
    while at < len(t):
        stop = at + size
        if stop >= len(t):
            return [*out, (at, len(t))]
        stop = inside(stop)[1] if inside(stop) else stop
        fine = [e for e in ends if at < e <= stop and not inside(e)]
        cut = fine[-1] if fine else stop
        if cut == stop:
            spaces = [i for i in range(at + 1, stop) if t[i] == " " and not inside(i)]
            cut = spaces[-1] if spaces else cut
        if len(t[at:cut].strip()) >= least:
            out.append((at, cut))
        back = cut - overlap
        if back <= (out[-1][0] if out else 0):
            back = cut
        at = back if back > at else at + size // 2
    return out


def test_pieces_equal_the_simple_rules_and_keep_formulas_whole():
    r = random.Random(2)
    parts = ["一句话。", "a few words. ", "$x^2 + 1$ ", "`code here`", "\\[ y = 3 \\] ", "plain text without an end ", "\n\n", "```\nblock\n``` ", "E^2 = m ", "$$ long formula with words $$ "]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 60)))
        regions = chunk.protected(t)
        got = chunk.pieces(t, 60, 8, 20)
        assert got == simple_pieces(t, 60, 8, 20, chunk.sentence_ends(t), regions), t
        assert all(not a < e < b for _, e in got[:-1] for a, b in regions)
    assert chunk.protected("a $x$ b `c` d \\(e\\) no $ one") == [(2, 5), (8, 11), (14, 19)]
    for hostile in ("$$" * 30_000 + "x", "\\[" * 50_000, "`" * 50_001, "a^+" * 20_000):
        began = time.time()
        chunk.pieces(hostile)
        assert time.time() - began < 5


def test_parents_group_sections_and_carry_chapters(spark):
    body = "这一段讲述运动的规律，内容完整。" * 20
    text_ = f"序言。\n第一章 运动\n1.1 位移\n{body}\n1.2 速度\n{body}\n1.3 加速度\n{body * 8}\n第二章 力\n短。"
    d = spark.createDataFrame([(1, text_), (2, None), (3, "")], "chunk_id long, text string")
    p = [r for r in chunk.parents(d).orderBy("parent").collect()]
    assert {r.chunk_id for r in p} == {1} and p[0].title == "" and p[0].chapter == "" and p[0].start == 0
    assert all(len(r.text) <= 1800 for r in p) and p[-1].chapter == "第二章 力" and {r.chapter for r in p[1:-1]} == {"第一章 运动"}
    squeeze = lambda x: "".join(x.split())
    assert squeeze("".join(r.text for r in p)) == squeeze(text_)
    c = chunk.children(d).collect()
    by = {r.parent: r for r in p}
    assert all(r.text in by[r.parent].text and r.chapter == by[r.parent].chapter and 120 <= len(r.text) for r in c)


def test_page_markers_and_front_matter(spark):
    d = spark.createDataFrame([(1, "x[[PAGE:1]]ab[[PAGE:12]]c"), (2, "none"), (3, "[[PAGE:3]]")], "chunk_id long, text string")
    got = {r.chunk_id: (r.clean, [(m.page, m.start) for m in r.markers]) for r in chunk.page_markers(d).collect()}
    assert got == {1: ("xabc", [(1, 1), (12, 3)]), 2: ("none", []), 3: ("", [(3, 0)])}
    d = spark.createDataFrame([(1, "---\ntitle: 'A: b'\nn: 1\n---\nbody --- x"), (2, "no --- matter"), (3, "---\nopen")], "chunk_id long, text string")
    got = {r.chunk_id: (r.body, r.meta) for r in chunk.front_matter(d).collect()}
    assert got[1][1] == {"title": "A: b", "n": "1"} and got[1][0].strip() == "body --- x" and got[2] == ("no --- matter", {}) and got[3] == ("---\nopen", {})


def test_chunks_by_bytes(spark):
    t = "一段。" * 3 + "\n\n" + "字" * 50 + "\n\n" + "b. " * 40
    got = [r.text for r in chunk.by_bytes(spark.createDataFrame([(1, t)], "chunk_id long, text string"), 60).orderBy("part").collect()]
    assert all(len(x.encode()) <= 60 for x in got) and "".join("".join(got).split()) == "".join(t.split()) and got[0] == "一段。" * 3


def test_similar_pairs_and_nearest_over_many_blocks(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(120, 8))
    v[::7] = v[1] + 0.01 * r.normal(size=v[::7].shape)
    v[5] = 0
    rows = [(i, "ab"[i % 2], v[i].tolist()) for i in range(120)] + [(500, "a", None)]
    d = spark.createDataFrame(rows, "chunk_id long, collection string, vec array<double>")
    unit = v / np.where(np.linalg.norm(v, axis=1) == 0, np.inf, np.linalg.norm(v, axis=1))[:, None]
    cosine = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if cosine[i, j] >= 0.6}
    for block in (7, 1000):
        got = govern.similar_pairs(d, 0.6, block).collect()
        assert {(x.a, x.b) for x in got} == want and len(got) == len(want) and all(abs(x.cosine - cosine[x.a, x.b]) < 1e-5 for x in got)
    q = d.filter("chunk_id < 30").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    fine = [i for i in range(120) if i != 5]
    for each in (False, True):
        got = {}
        for x in retrieve.dense(q, d.repartition(3), 4, block=11, each=each).collect():
            got.setdefault((x.query_id, x.collection if each else ""), []).append((x.rn, x.chunk_id))
        for i in range(30):
            if i == 5:
                continue
            for name in ("ab" if each else [""]):
                pool = [c for c in fine if not each or "ab"[c % 2] == name]
                assert [c for _, c in sorted(got[i, name])] == sorted(pool, key=lambda c: (-cosine[i, c], c))[:4]
        assert not any(k[0] == 5 for k in got)


def test_hot_keys_are_looked_up(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = lookup.look_up(rows, table, "k", least=100)
    assert got.count() == 9000 and {r.m for r in got.filter("k = 0").collect()} == {8997}


def test_dedupe_conserves_rows_and_keeps_kinds_apart(spark):
    rows = [(1, "long text one", "child", [1.0, 0.0]), (2, "text", "child", [1.0, 0.01]), (3, "text", "parent", [1.0, 0.0]), (4, "tex t", "child", [0.0, 1.0]), (5, " ", "child", None), (6, "alone", "child", None)]
    d = spark.createDataFrame(rows, "chunk_id long, text string, doc_type string, vec array<double>")
    kept, dropped = govern.dedupe(d, 0.9)
    assert sorted(r.chunk_id for r in kept.collect()) == [1, 3, 6]
    assert sorted((r.chunk_id, r.dup_reason, r.dup_of) for r in dropped.collect()) == [(2, "semantic", 1), (4, "exact", 2), (5, "empty", None)]


CONTENT = json.dumps({"subject": "science", "grade": "10", "note": 1, "topics": [{"name": "T", "concepts": [{"name": "Introduction", "summary": "start here"}], "subtopics": [
    {"name": "A", "concepts": [{"name": "c1", "summary": "s1", "steps": ["one"], "questions": [{"question": "q?", "acceptable_answers": ["yes"], "hints": [], "x": 2}]}],
     "subtopics": [{"name": "B", "concepts": [{"name": "c2", "summary": "about motion", "steps": [], "questions": []}]}]}]}]})


def test_content_is_checked_and_unknown_keys_go():
    got = outline.checked(CONTENT)
    assert got["dropped"] == ["note", "topics[0].concepts", "topics[0].subtopics[0].concepts[0].questions[0].x"] and got["errors"] == []
    assert "note" not in json.loads(got["content"])
    bad = {"subject": "", "grade": 13, "topics": [{"name": "T", "subtopics": [{"name": "A"}, 3]}, {"subtopics": "x"}]}
    assert outline.checked(json.dumps(bad))["errors"] == [
        "subject is empty", "grade is no grade from 1 to 12", "topics[0].subtopics[0] has none of concepts, subtopics", "topics[0].subtopics[1] is no object",
        "topics[1].name is missing", "topics[1].subtopics is no list",
    ]
    assert outline.checked("{")["content"] is None and outline.checked(None) is None
    deep = {"name": "x", "subtopics": []}
    for _ in range(300):
        deep = {"name": "x", "subtopics": [deep]}
    assert outline.checked(json.dumps({"subject": "s", "grade": 1, "topics": [{"name": "t", "subtopics": [deep]}]}))["errors"] == []


def test_content_lookups_and_search(spark):
    o = content.outline(spark.createDataFrame([("science", CONTENT), ("none", None)], "subject string, content string")).cache()
    assert [(r.name, r.path) for r in o.orderBy("ord").collect()] == [("Introduction", []), ("c1", ["A"]), ("c2", ["A", "B"])]
    assert content.find_concept(o, "science", "T", "c2").first().summary == "about motion"
    assert content.find_question(o, "science", "T", "c1", 0).first().question == "q?"
    assert content.find_question(o, "science", "T", "c1", 1).count() == content.find_question(o, "science", "T", "c1", -1).count() == 0
    assert {r.name for r in content.concepts_at(o, "science", "T", ("A",)).collect()} == {"c1", "c2"}
    assert content.default_context(o, "f").first().text == "start here" and content.default_context(o.limit(0), "f").first().text == "f"
    q = spark.createDataFrame([(1, "motion ABOUT"), (2, "about motio"), (3, "zzz"), (4, "")], "query_id int, text string")
    got = [(r.query_id, r.name) for r in content.search(o, q, 2).collect()]
    assert {x for x in got if x[0] < 4} == {(1, "c2"), (2, "c2")} and len([x for x in got if x[0] == 4]) == 2
    assert outline.lines(CONTENT).split("\n")[:4] == ["subject: science", "grade: 10", "name: T", "name: Introduction"]


def test_deep_paths(spark):
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(11)] + [("x", "y", "loop"), ("y", "x", "loop")], "id string, parent string, name string")
    got = {r.id: r.path for r in content.paths(nodes).collect()}
    assert got["10"] == [f"n{i}" for i in range(11)] and "x" not in got


def test_semantic_cache(spark):
    e = [("old", "m", "1", "2024-01-01 00:00:00", [1.0, 0.0]), ("near", "m", "1", "2024-01-01 10:00:00", [1.0, 0.1]), ("other", "m", "2", "2024-01-01 10:00:00", [1.0, 0.0]), ("zero", "m", "1", "2024-01-01 10:00:00", [0.0, 0.0]), ("long", "m", "1", "2024-01-01 10:00:00", [1.0, 0.0, 0.0])]
    entries = spark.createDataFrame(e, "key string, subject string, grade string, ts string, vec array<double>").withColumn("ts", F.to_timestamp("ts"))
    asked = spark.createDataFrame([(1, "m", "1", [1.0, 0.0]), (2, "m", "1", [0.0, 1.0]), (3, "x", "1", [1.0, 0.0])], "query_id int, subject string, grade string, qvec array<double>")
    assert [(r.query_id, r.key) for r in evaluate.similar_entries(asked, entries, "2024-01-01 10:30:00").collect()] == [(1, "near")]


def test_semantic_cache_of_many_questions(spark):
    """No pair becomes a row; many blocks and batches, copies, ties after rounding, two sizes in a group, numbers that are not finite."""
    r = np.random.default_rng(3)
    v = r.normal(size=(6000, 16))
    v[1::5] = v[1]
    v[2::9] = v[2] * (1 + 1e-7 * r.normal(size=v[2::9].shape))
    v[3::50] = np.sign(v[3::50])
    v[4] = 0
    v[5, 3] = np.nan
    size = np.where(np.arange(6000) % 7 == 0, 8, 16)
    rows = [(i, i % 2, i * 37 % 10, v[i, : size[i]].tolist()) for i in range(6000)]
    rows += [(6001, 1, 0, None), (6002, 1, 0, [None] * 16), (6003, None, 0, v[1].tolist())]
    d = spark.createDataFrame(rows, "i int, subject int, s int, v array<double>").withColumn("grade", F.lit("1")).repartition(3)
    asked = d.filter("i < 1500 or i > 6000").select(F.col("i").alias("query_id"), "subject", "grade", F.col("v").alias("qvec"))
    entries = d.filter("i >= 1500 or i < 6 or i > 6000").select(F.concat(F.lit("k"), F.lpad("i", 4, "0")).alias("key"), "subject", "grade", F.timestamp_seconds("s").alias("ts"), F.col("v").alias("vec"))
    want = {}
    owns = np.array([*range(6), *range(1500, 6000)])
    owns = owns[np.lexsort((owns, owns * 37 % 10))]
    for n in (8, 16):
        for kind in (0, 1):
            fine = [i for i in owns if size[i] == n and i % 2 == kind and i not in (4, 5)]
            mine = [i for i in range(1500) if size[i] == n and i % 2 == kind and i not in (4, 5)]
            unit = lambda at: v[at, :n] / np.linalg.norm(v[at, :n], axis=1)[:, None]  # noqa: E731, B023
            score = np.round(unit(mine) @ unit(fine).T, 6)
            first = score.argmax(axis=1)
            want |= {i: (f"k{fine[j]:04d}", x) for i, j, x in zip(mine, first, score.max(axis=1), strict=True) if x >= 0.7}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        found = evaluate.similar_entries(asked, entries, "1970-01-01 00:30:00", 0.7, numbers=9000)
        got = {x.query_id: (x.key, x.cosine) for x in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 700 and got == want and found.schema["query_id"].dataType.simpleString() == "int"
    assert "Join" not in found._jdf.queryExecution().toString()
    assert evaluate.similar_entries(asked.limit(0), entries, "1970-01-01 00:30:00").count() == evaluate.similar_entries(asked, entries.limit(0), "1970-01-01 00:30:00").count() == 0


def test_semantic_cache_rounds_as_sql_does(spark):
    """Signs in 256 places: cosines are 128ths, many of them halfway between two values of six places."""
    r = np.random.default_rng(4)
    v = np.sign(r.normal(size=(400, 256)))
    d = spark.createDataFrame([(i, v[i].tolist()) for i in range(400)], "i long, vec array<double>").withColumn("k", F.lit(1))
    con = duckdb.connect()
    t = con.from_arrow(d.toArrow())  # noqa: F841
    want = con.execute("""select a.i, b.i, round(list_cosine_similarity(a.vec, b.vec), 6) as c from t a, t b where a.i < 100 and b.i >= 100
        qualify row_number() over (partition by a.i order by c desc, b.i) = 1""").fetchall()
    asked = d.filter("i < 100").select(F.col("i").alias("query_id"), F.col("k").alias("subject"), F.col("k").alias("grade"), F.col("vec").alias("qvec"))
    entries = d.filter("i >= 100").select(F.col("i").alias("key"), F.col("k").alias("subject"), F.col("k").alias("grade"), F.timestamp_seconds("k").alias("ts"), "vec")
    assert sorted(x[:] for x in evaluate.similar_entries(asked, entries, "1970-01-01 00:30:00", 0.1).collect()) == sorted(want)


def test_registered_functions_in_sql(spark):
    register.register(spark)
    assert spark.sql("select strip_latex('$x^{2}$'), similarity('abc', 'abd') > 0.6, text_unit_length('向心力 ab'), estimate_tokens('向心abcdefghij')").first()[:] == ("x²", True, 4, 5)
    text_ = "一句话。" * 200
    rows = spark.sql(f"select p.piece, p.text from values ('{text_}') as t(x), lateral pieces_of(t.x) as p").collect()
    assert len(rows) > 1 and all(r.text.endswith("。") for r in rows)
    assert spark.sql("select s.sentence from values ('a. b. c') as t(x), lateral sentences_of(t.x) as s").count() == 3


def test_sync_appends_each_key_once(spark, tmp_path):
    kind, store = "key string, v int", str(tmp_path / "store")
    for i, rows in enumerate(([("a", 1), ("a", 2), ("b", 1)], [("b", 3), ("c", 1)])):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("key string, v int").parquet(str(tmp_path / "in"))
        jobs.sync(s, store, "key", str(tmp_path / "check")).awaitTermination(60)
        assert sorted(r.key for r in spark.read.parquet(store).collect()) == (["a", "b"] if i == 0 else ["a", "b", "c"])


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("s", 1, "text a"), ("s", 2, "text b")], "source string, n int, text string")
    files.chunk_files(d, str(tmp_path / "chunks"), "source")
    assert "# n: 1\ntext a" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "chunks/source=s")).collect())
    files.report_lines(d.select("n", "text"), str(tmp_path / "report"), "Title")
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()][:6] == ["# Title", "", "| n | text |", "|---|---|", "| 1 | text a |", "| 2 | text b |"]
    files.save_progress(spark.createDataFrame([(1, 5), (2, 6)], "user_id int, correct int"), str(tmp_path / "p"))
    files.save_progress(spark.createDataFrame([(1, 9)], "user_id int, correct int"), str(tmp_path / "p"))
    assert {(r.user_id, r.correct) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, 9), (2, 6)}


def test_answers_grades_and_files(spark):
    assert one(spark, rules.cleaned_answer(F.col("a")), a="A: it is\nQ: so  what\nExercise: do") == "it is so what."
    assert one(spark, rules.confidence(F.col("a"), F.col("b")), a="one two three four five", b="one six") == 0.75
    assert one(spark, rules.safe_file(F.col("a"), F.lit(5)), a="a/b.txt") and not one(spark, rules.safe_file(F.col("a"), F.lit(5)), a="a/../../b")
    assert one(spark, route.grade_label(F.col("a")), a="11") == "高二" and one(spark, route.grade_label(F.col("a")), a="9") == ""
    assert one(spark, route.diagram_key(F.col("a")), a="Draw the animal CELL") == "cell_plant"


def test_parents_take_over_with_the_childs_metadata(spark):
    hits = spark.createDataFrame([(1, "c", 1, 7, "child", 1, {"page": "3", "title": ""}), (1, "c", 2, 7, "later", 2, None), (1, "c", 3, 9, "orphan", 3, {"a": "b"})],
                                 "query_id int, collection string, chunk_id int, parent_id int, text string, rank int, meta map<string,string>")
    parents = spark.createDataFrame([("c", 7, "whole", {"title": "T", "page": "1"})], "collection string, parent_id int, parent_text string, parent_meta map<string,string>")
    got = {r.chunk_id: (r.text, r.meta) for r in retrieve.expand_parents(hits, parents).collect()}
    assert got == {1: ("whole", {"title": "T", "page": "3"}), 3: ("orphan", {"a": "b"})}


def test_rule_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text('groups:\n- terms: ["自由落体", "自由下落", " 自由下落 "]\n- terms: [one]\n- terms: ["自由落体", "落体"]\n')
    got = {(r.term, r.synonym, r.ord) for r in dims.synonyms(spark, str(tmp_path / "s.yaml")).collect()}
    assert got == {("自由落体", "自由下落", 0), ("自由落体", "落体", 1), ("自由下落", "自由落体", 0), ("落体", "自由落体", 0)}
    (tmp_path / "b.yaml").write_text('books:\n- id: p1\n  match_all: [["Physics (1)", "物理"], ["一"]]\n  exclude: [Lab]\n  grade: 10\n  grade_span: [10, 11]\n- id: any\n  match_all: [[book]]\n')
    b = dims.books(spark, str(tmp_path / "b.yaml"))
    names = spark.createDataFrame([("物理 第一册",), ("物理 一 LAB book",), ("x",)], "name string")
    assert {r.name: r.book_id for r in route.match_books(names, b).collect()} == {"物理 第一册": "p1", "物理 一 LAB book": "any", "x": None}
    (tmp_path / "e.yaml").write_text("")
    assert dims.synonyms(spark, str(tmp_path / "e.yaml")).count() == 0


def test_vectors_for_models(spark):
    d = spark.createDataFrame([(1, "q", [3.0, 4.0]), (2, " ", None), (3, None, [0.0, 0.0]), (4, "x", [1.0])], "id int, t string, v array<double>")
    got = d.select("id", text.embedding_input(F.col("t"), True).alias("q"), text.embedding_input(F.col("t")).alias("p"), text.unit_vector(F.col("v"), 2).alias("u")).orderBy("id").collect()
    assert [r.q for r in got] == [text.QUERY_INSTRUCTION + "q", None, None, text.QUERY_INSTRUCTION + "x"] and got[0].p == "q"
    assert [r.u for r in got] == [[0.6, 0.8], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_evidence_is_cut_at_a_sentence_end(spark):
    rows = [(1, 4, "w" * 900 + ". " + "w" * 40000, 0.3)]
    got = retrieve.pack_evidence(spark.createDataFrame(rows, "query_id int, chunk_id int, text string, final_score double"), 1000).first()
    assert got.text == "w" * 900 + "." and got.tokens == 270


def test_gold_of_items_short_and_inside_words(spark, tmp_path):
    docs = [(1, "say cats are nice today and the dogs run over all of the green hills"), (2, "unrelated words"), (3, "ab")]
    items = [(10, "ats are nice tod"), (11, "dogs run over all of the green h"), (12, "ab"), (13, "nice are"), (14, "")]
    for name, rows, kind in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.query_id, r.chunk_id) for r in evaluation.gold(Tables(spark, str(tmp_path))).collect()}
    assert got == {(10, 1), (11, 1), (12, 3)}


def test_content_types(spark):
    assert one(spark, chunk.content_type(F.col("a")), a="\n".join(f"1.{i} 标题" for i in range(6))) == "toc"
    assert one(spark, chunk.content_type(F.col("a")), a="所谓力，是指物体间的作用") == "definition"


def test_routing_keeps_unknown_subjects_empty(spark):
    q = spark.createDataFrame([(1, "science", "physics", "10"), (2, "none", "x", "1")], "query_id int, subject string, discipline string, grade string")
    c = spark.createDataFrame([("neb_a", "science", "physics", "11"), ("neb_b", "science", "physics", "10"), ("neb_c", "science", "bio", "10")], "collection string, subject string, discipline string, grade string")
    assert [(r.query_id, r.collection) for r in route.route(q, c).orderBy("pos").collect()] == [(1, "neb_b"), (1, "neb_a")]


def test_zlib_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 100),), (None,)], "b binary")
    got = df.select(package.inflate(package.deflate(F.col("b"))).alias("x"), package.inflate(F.col("b")).alias("raw")).collect()
    assert bytes(got[0].x) == b"abc" * 100 == bytes(got[0].raw) and got[1].x is None


def test_flips_and_paths(spark):
    runs = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True), (1, "b", False)], "run int, id string, outcome boolean")
    assert {r.id: r.n_flips for r in evaluate.flips(runs).collect()} == {"a": 1, "b": 0}
    nodes = spark.createDataFrame([("1", None, "A"), ("2", "1", "B"), ("3", "2", "C")], "id string, parent string, name string")
    assert {r.id: r.path for r in content.paths(nodes).collect()}["3"] == ["A", "B", "C"]


def test_stream_of_days(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_type", "ts", "value")
    e.write.parquet(str(tmp_path / "in"))
    s = jobs.read(spark, str(tmp_path / "in"), e.schema.simpleString()[7:-1].replace(":", " "))
    q = jobs.daily(s).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("days").count() == jobs.daily(e).count()
