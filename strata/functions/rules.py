"""Rules over questions, answers and names as column expressions; the first that holds wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import bigrams, estimate_tokens, one_space, overlap, unit_length, units

# Fixed values of the rules.
STARTERS = ("^hey\\s+", "^hi\\s+", "^so\\s+")
SLANG = (
    ("\\bgonna\\b", "going to"), ("\\bwanna\\b", "want to"), ("\\bcoz\\b", "because"),
    ("\\bu\\b", "you"), ("\\bur\\b", "your"), ("\\bidk\\b", "I do not know"),
)
FILLERS = ("\\blike\\b", "\\bbasically\\b", "\\bactually\\b", "\\bjust\\b")
POLITE = ("^can you (please )?tell me ", "^please (tell me|explain) ")
EXAM_PHRASES = (
    "with reference to the (figure|diagram|graph|table|passage|text) (above|below|given)",
    "according to the (passage|text|diagram|figure)",
    "write short notes? on", "explain (in )?brief(ly)?", "give reasons?", "in your own words",
)
ABBREVIATIONS = (
    ("\\bEMF\\b", "electromotive force"), ("\\bAC\\b", "alternating current"),
    ("\\bDC\\b", "direct current"), ("\\bDNA\\b", "deoxyribonucleic acid"),
)
INTENTS = (
    ("WHY", "^why |what is the reason|what causes"),
    ("HOW", "^how |what is the process"),
    ("DESCRIBE", "^describe |^explain |what happens"),
    ("DEFINE", "^define |what does .+ mean"),
    ("COMPARE", "difference between|compare |versus"),
    ("SOLVE", "^solve |^calculate |^find "),
)
GREETINGS = ("hi", "hello", "namaste", "namaskar", "hey", "good morning", "good afternoon", "good evening")
THANKS = ("thank you", "thanks", "thx", "dhanyabad")
APOLOGIES = ("sorry", "i'm sorry", "my bad", "apologies")
MATH = ("+", "=", "/", "*", "√", "^", "solve", "calculate", "equation")
CREATION = (
    "(?:写|编|作|撰写|创作|续写|改写|仿写|誊写)[^。？！?!]{0,12}?"
    "(?:散文|诗歌|诗|议论文|记叙文|说明文|作文|文章|小说|故事|剧本|台词|标题|读后感|"
    "倡议书|演讲稿|请假条|周记|日记|情书|誓词|发言稿|推荐信|倡议|书评|影评)"
)
CREATION_EXEMPT = (
    "怎么|如何|为什么|为何|是什么|有哪些|区别|作用|意思|赏析|立意|表达方式|写法特点|"
    "中心思想|主旨|修辞|词语|句子|段落|结构|思路|评分标准|要求"
)
ADMISSIONS = (
    "i don't have that information", "my knowledge cutoff", "unrelated to the context", "based on general knowledge",
    "i couldn't find", "not mentioned in the context", "根据常识", "根据一般常识", "我推测", "一般来说", "教材中没有", "材料中未找到",
)
CHAT = (
    "hello", "hi", "hey", "thanks", "thank you", "what can you", "who are you", "what is your name", "help me", "can you help",
)
TERMS = (
    "function", "variable", "class", "method", "algorithm", "syntax", "loop", "array", "string", "integer",
    "grammar", "sentence", "paragraph", "essay", "equation", "formula", "theorem", "proof",
)
STUDY = ("what is", "how does", "explain", "define", "describe", "chapter", "lesson", "topic", "concept", "subject")
VISUAL = (
    "how does", "how do", "explain", "describe", "process", "steps", "compare", "difference", "types of", "classification",
    "structure", "parts of", "stages", "cycle", "hierarchy",
)
FACTUAL = ("what year", "when did", "who invented", "what is the capital", "in which year")
NO_DIAGRAM = "\\b(solve|calculate|compute|evaluate)\\b|\\b(formula|equation|algebra)\\b|[+\\-*/=]{2,}"
DIAGRAM = (
    "\\b(how|process|work|flow|step|stage|phase)\\b|\\b(structure|parts|components|hierarchy|layer)\\b|"
    "\\b(cycle|loop|path|sequence|order)\\b|\\b(compare|difference|relationship|types)\\b"
)
NOISE_WORDS = (
    "please", "can you", "help me", "tell me", "like", "basically", "actually", "just", "really", "bro", "bruh", "sir",
)
NOISE_PATTERN = "^(can|could|would) you|^please|help me|with reference|according to|in brief"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0b\\f\\r]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def formal(q: Column) -> Column:
    """Without starters, slang, fillers and politeness."""
    for p in STARTERS:
        q = F.regexp_replace(q, f"(?i){p}", "")
    for p, to in SLANG:
        q = F.regexp_replace(q, f"(?i){p}", to)
    for p in (*FILLERS, *POLITE):
        q = F.regexp_replace(q, f"(?i){p}", "")
    return one_space(q)


def without_exam_phrases(q: Column) -> Column:
    for p in EXAM_PHRASES:
        q = F.regexp_replace(q, f"(?i){p}", "")
    return F.regexp_replace(one_space(q), "^[,:;\\-\\s]+", "")


def with_abbreviations(q: Column) -> Column:
    for p, to in ABBREVIATIONS:
        q = F.regexp_replace(q, p, to)
    return q


def as_sentence(q: Column) -> Column:
    """A capital at the start, and one question mark after a question word."""
    q = F.when((F.upper(q) == q) & (F.lower(q) != q), F.concat(F.upper(F.substring(q, 1, 1)), F.lower(F.substr(q, F.lit(2))))).otherwise(q)
    q = F.concat(F.upper(F.substring(q, 1, 1)), F.substr(q, F.lit(2)))
    asks = F.lower(q).rlike("^(what|why|how|when|where|who)")
    q = F.when(asks & ~q.endswith("?"), F.concat(F.regexp_replace(q, "[.!,;:]+$", ""), F.lit("?"))).otherwise(q)
    return F.regexp_replace(q, "\\?+", "?")


#: A context, and the words of which a vague question about it has one.
CONTEXTS = (("electric circuit", ("switch", "circuit")), ("cell", ("mitochondria", "chloroplast")))


def in_context(q: Column) -> Column:
    """``what happens when`` with ``in a <context>`` put in, for questions of up to 15 words that do not name the context."""
    low = F.lower(q)
    fits = F.size(F.split(F.trim(q), "\\s+")) <= 15
    out = q
    for context, needed in reversed(CONTEXTS):
        named = F.regexp_replace(q, "(?i)^(.*?what happens)(?=\\s+(?:when|if))", f"$1 in a {context}")
        out = F.when(fits & contains_any(low, needed) & ~low.contains(context), named).otherwise(out)
    return out


def without_learned(q: Column, phrases: tuple[str, ...]) -> Column:
    """Without phrases that mining has found, whatever their case."""
    for p in phrases:
        q = F.regexp_replace(q, f"(?i){re.escape(p)}", "")
    return F.regexp_replace(one_space(q), "^[,:;\\-\\s]+", "")


def normalised(q: Column, learned: tuple[str, ...] = ()) -> Column:
    """All steps in order; fuzzy exam phrases are taken out by functions.latex.fuzzy_removed before it."""
    return in_context(as_sentence(with_abbreviations(without_learned(without_exam_phrases(formal(q)), learned))))


def intent(q: Column) -> Column:
    out = F.when(F.lower(q).rlike(INTENTS[0][1]), INTENTS[0][0])
    for name, p in INTENTS[1:]:
        out = out.when(F.lower(q).rlike(p), name)
    return out.otherwise("DESCRIBE")


def normaliser_confidence(original: Column, clean: Column, n_notes: Column) -> Column:
    loss = F.when(F.length(clean) / F.greatest(F.length(original), F.lit(1)) < 0.5, 0.2).otherwise(0.0)
    loss = loss + F.when(n_notes > 5, 0.15).when(n_notes > 3, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.lit(1.0) - loss))


def edge_case(q: Column) -> Column:
    """empty, short, greeting, thanks, apology; null for a question to answer."""
    s = F.lower(F.trim(F.coalesce(q, F.lit(""))))
    return (
        F.when(s == "", "empty").when(F.length(s) < 4, "short").when(s.isin(*GREETINGS), "greeting")
        .when(s.isin(*THANKS), "thanks").when(s.isin(*APOLOGIES), "apology")
    )


def is_math(q: Column) -> Column:
    return contains_any(F.lower(q), MATH)


def is_creation(q: Column) -> Column:
    """A request for a finished piece of writing, and not a question about writing."""
    q = F.trim(F.coalesce(q, F.lit("")))
    return q.rlike(CREATION) & ~q.rlike(CREATION_EXEMPT)


def wants_retrieval(q: Column) -> Column:
    low = F.lower(F.trim(q))
    return (
        F.when(q.isNull() | (F.length(F.trim(q)) < 5), False).when(contains_any(low, CHAT), False)
        .when((n_words(q) < 4) & ~contains_any(low, TERMS), False).when(contains_any(low, STUDY), True)
        .otherwise(n_words(q) > 10)
    )


def context_is_relevant(q: Column, context: Column) -> Column:
    """Two words of over three letters, or one of over five, are in the context."""
    low = F.lower(context)
    found = F.filter(F.array_distinct(F.filter(words(F.lower(q)), lambda w: F.length(w) > 3)), lambda w: low.contains(w))
    enough = (F.size(found) >= 2) | F.exists(found, lambda w: F.length(w) > 5)
    return F.when(context.isNull() | (F.length(F.trim(context)) < 20), False).otherwise(enough)


def may_have_diagram(q: Column) -> Column:
    low = F.lower(q)
    return ~low.rlike(NO_DIAGRAM) & low.rlike(DIAGRAM)


def shows_diagram(q: Column, answer: Column, match: Column) -> Column:
    low = F.lower(q)
    return (match >= 0.3) & contains_any(low, VISUAL) & (n_words(answer) > 25) & ~contains_any(low, FACTUAL)


def valid_user(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_]{3,32}$"), F.lit(False))


def spell_gate(q: Column) -> Column:
    """Whether spelling is worth checking."""
    odd = q.rlike("\\b\\w*[0-9]+\\w*\\b") | q.rlike("\\b\\w{15,}\\b") | q.rlike("(.)\\1{3,}")
    return (
        F.when(n_words(q) < 5, False).when(q.rlike("^[A-D]\\)|^\\d+\\."), False)
        .when((F.upper(q) == q) & (F.lower(q) != q), False).when(odd, True).otherwise(n_words(q) > 10)
    )


def confidence(answer: Column, question: Column, evidence: Column) -> Column:
    """Of length, relevance to the question and mean evidence score."""
    n = unit_length(answer)
    by_length = F.when(n.between(30, 200), 1.0).when(n.between(15, 29) | n.between(201, 300), 0.7).otherwise(0.4)
    relevance = F.size(F.array_intersect(units(question), units(answer))) / F.greatest(F.size(units(question)), F.lit(1))
    score = 0.40 * by_length + 0.25 * relevance + 0.35 * F.coalesce(evidence, F.lit(0.0))
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(n < 5, 0.3).otherwise(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    )


def grounding(answer: Column, context: Column, weakest: float = 0.15) -> Column:
    """no_context, grounded, admitted or weak_overlap."""
    empty = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context, F.lit("")) == "")
    return (
        F.when(empty, "no_context").when(F.size(units(answer)) < 10, "grounded")
        .when(contains_any(F.lower(answer), ADMISSIONS), "admitted")
        .when(overlap(bigrams(answer), bigrams(context)) < weakest, "weak_overlap").otherwise("grounded")
    )


def adjusted(score: Column, status: Column, n_out_of_range: Column) -> Column:
    """A confidence after grounding and citation checks."""
    s = F.when(status == "admitted", F.least(score, F.lit(0.4))).when(status == "weak_overlap", F.round(score * 0.7, 3)).otherwise(score)
    return F.when(n_out_of_range > 0, F.round(s * 0.85, 3)).otherwise(s)


def citations_in(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d{1,2})\\]"), F.lit(1)), lambda x: x.cast("int"))


def budget(system_tokens: Column, history_tokens: Column, context: int = 4096, output: int = 768, most: int = 2000) -> Column:
    left = F.lit(context) - (system_tokens + 40) - history_tokens - output
    return F.greatest(F.lit(200), F.least(left, F.lit(most)))


def prompt(question: Column, context: Column, history: Column) -> Column:
    none = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    return F.concat_ws("\n\n", F.lit("Answer clearly and correctly."), none(history), none(context), none(question))


def clean_name(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-zA-Z0-9._-]", "_"), F.lit("._-"))


def collection_name(subject: Column, grade: Column, discipline: Column, split: tuple[str, ...] = ("science",), prefix: str = "neb") -> Column:
    key = F.coalesce(F.nullif(clean_name(subject), F.lit("")), F.lit("general"))
    own = clean_name(discipline)
    key = F.when(key.isin(*split) & (own != "") & (own != key), own).otherwise(key)
    g = clean_name(F.coalesce(grade, F.lit("unknown")))
    return F.when(g.isin("", "unknown"), F.concat(F.lit(f"{prefix}_"), key)).otherwise(
        F.concat(F.lit(f"{prefix}_"), key, F.lit("_grade_"), g)
    )


def noise_likely(phrase: Column) -> Column:
    return contains_any(F.lower(phrase), NOISE_WORDS) | F.lower(phrase).rlike(NOISE_PATTERN)


def history_tokens(question: Column, answer: Column) -> Column:
    return estimate_tokens(F.concat(F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))))


def confidence(answer: Column, question: Column) -> Column:
    """0.3 under five units, else a half and half the share of the question's units in the answer, at most 1."""
    asked, told = units(question), units(answer)
    share = F.size(F.array_intersect(asked, told)) / F.greatest(F.lit(1), F.size(asked))
    return F.when(F.size(told) < 5, F.lit(0.3)).otherwise(F.least(F.lit(1.0), 0.5 + share * 0.5))


#: Marks after which an answer is cut.
OFF_MARKS = ("Exercise:", "Practice:", "Try this:", "Use Case:", "Real-world", "练习：", "习题：", "试试：", "用例：", "现实世界")


def cleaned_answer(answer: Column) -> Column:
    """An answer without Q: and A: at line starts and without what follows a mark, in single spaces, with a full stop at its end."""
    out = F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), "(?i)^(Q:|A:)\\s*", "")
    out = F.regexp_replace(out, "(?i)\\n(Q:|A:)\\s*", "\n")
    for mark in OFF_MARKS:
        out = F.trim(F.substring_index(out, mark, 1))
    out = F.trim(F.regexp_replace(out, "\\s+", " "))
    return F.when((out != "") & ~out.rlike("[.!?]$"), F.concat(out, F.lit("."))).otherwise(out)


def safe_file(path: Column, size: Column, most: int = 10 << 20) -> Column:
    """Whether a path stays below its root (not absolute, no step up) and its size is within the limit."""
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce((path != "") & ~path.rlike("^(/|[A-Za-z]:)") & ~F.array_contains(steps, "..") & size.between(0, most), F.lit(False))
