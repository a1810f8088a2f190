"""Secret scan: three fixed patterns, and random strings found by two character Markov models.

Base spans are the matches of the patterns. The method adds spans of kind ``random``: long runs of token characters, off the
base spans, that a first-order Markov model of random strings explains far better than one of ordinary identifiers (sum of
log-likelihood ratios of character transitions of at least MIN_LLR). Both models are trained from labelled samples of
SAMPLE_DOCS documents, chosen by hash of the id, which is the documented bound: random are the keys and hexadecimal strings that
the patterns find there and strings made from seeded hashes, ordinary are all other tokens of these texts, digits and marks
included, and their snake_case, camelCase, path and numbered forms. The table has one entry per pair of alphabet classes, so its
size is fixed.

Built-in functions only. Places come from splitting a text at its matches and summing lengths (running_sums).

Cases: null and empty texts have no spans (base_sha256 is that of the empty string); null ids stay null, and are not sampled;
repeated rows are scanned one by one; ties at one start are ordered by kind; very long texts stay whole, in near-linear time in
length and number of spans; an empty table gives an empty result (the models are then trained on made strings alone and score
nothing); other columns are not carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import let, running_maxima, running_sums, text_of

#: Fixed values of the contract. Case is ignored for ASCII letters only, as Java's (?i) does.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LLR = 20.0
SAMPLES, SAMPLE_DOCS, SEED = 1000, 1000, 77
#: Longer tokens are not samples.
LONGEST = 200
#: Classes of characters: 0 the ends of a token, 1 to 94 printable ASCII, 95 the rest.
CLASSES = 96

_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: int, passes, group: int = 0) -> Column:
    """Spans of all leftmost matches that passes, given a struct of place and length of match and of the group."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    long = lambda x: F.length(x).cast("long")

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: long(gap) + long(m))
        spans = F.zip_with(
            running_sums(steps), found, lambda e, m: F.struct((e - long(m)).alias("s"), F.lit(kind).alias("k"), e.alias("e"))
        )
        rows = F.zip_with(spans, value if group else found, lambda r, v: F.struct(r.alias("r"), v.alias("v")))
        return F.transform(F.filter(rows, lambda x: passes(x.v)), lambda x: x.r)

    return F.when(text.rlike(pattern), let(every, placed)).otherwise(_none())


def _classes(token: Column) -> Column:
    """Character classes of a token, with its two ends."""
    code = lambda c: F.when((F.ascii(c) >= 33) & (F.ascii(c) <= 126), F.ascii(c) - 32).otherwise(F.lit(95))
    end = F.array(F.lit(0))
    return F.concat(end, F.transform(F.split(token, ""), code), end)


def samples(spark: SparkSession, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Labelled samples: token, random (1) or ordinary (0). At most 5 * SAMPLES made tokens and those of SAMPLE_DOCS ids."""
    key = F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string"))
    long_hash = F.concat(F.sha2(key, 256), F.sha2(F.concat(key, F.lit("b")), 256))
    b64 = F.regexp_replace(F.base64(F.unhex(long_hash)), r"\s", "")
    made = spark.range(0, SAMPLES, 1, 1).select(
        F.explode(
            F.array(
                F.substring(long_hash, 1, 40),
                F.upper(F.substring(long_hash, 41, 40)),
                F.substring(b64, 1, 40),
                F.regexp_replace(F.substring(b64, 41, 40), "[+/=]", "_"),
                F.upper(F.regexp_replace(F.substring(b64, 9, 36), "[+/=]", "7")),
            )
        ).alias("token"),
        F.lit(1).alias("random"),
    )
    # the first pass reads ids only
    ids = docs.select(docs[id_col].alias("id"), F.xxhash64(F.lit(SEED), docs[id_col]).alias("h")).filter("id is not null").distinct()
    chosen = ids.orderBy("h", "id").limit(SAMPLE_DOCS).select("id")
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("t")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.min("t").alias("t"))
    told = F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (ACCESS.replace("+", "{12,}"), HEX.replace("+", "{32,}"))])
    rest = F.col("t")
    for p in (ASSIGN, ACCESS, HEX.replace("+", "{32,}")):
        rest = F.regexp_replace(rest, p, " ")
    found = texts.select(told.alias("told"), F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0)).alias("words"))
    secret = found.select(F.explode("told").alias("token"), F.lit(1).alias("random")).distinct()
    words = found.select(F.explode("words").alias("w")).filter(F.length("w") <= LONGEST).distinct()
    w = F.col("w")
    forms = F.array(
        w,
        F.concat(w, F.lit("_"), w, F.lit("_name")),
        F.concat(F.lower(w), F.initcap(w), F.lit("Id")),
        F.concat(F.lit("src/"), w, F.lit("-item/"), w),
        F.concat(w, F.lit("_"), F.pmod(F.xxhash64(w), F.lit(2100)).cast("string")),
    )
    ordinary = words.select(F.explode(forms).alias("token"), F.lit(0).alias("random"))
    return made.unionByName(secret).unionByName(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios by class of one character times CLASSES plus class of the next.

    One row for each pair of classes and label reaches the driver: at most 2 * CLASSES squared.
    """
    c = labelled.select("random", _classes(F.col("token")).alias("c"))
    pairs = c.select(
        "random",
        F.explode(F.transform(F.slice("c", 2, F.size("c")), lambda b, i: F.get(F.col("c"), i) * CLASSES + b)).alias("pair"),
    )
    counts = [[0.0] * (CLASSES * CLASSES) for _ in range(2)]
    for row in pairs.groupBy("random", "pair").count().collect():
        counts[row["random"]][row["pair"]] = float(row["count"])
    out = []
    for a in range(CLASSES):
        span = range(a * CLASSES, (a + 1) * CLASSES)
        total = [sum(counts[k][i] for i in span) + 0.5 * CLASSES for k in range(2)]
        out += [math.log((counts[1][i] + 0.5) / total[1]) - math.log((counts[0][i] + 0.5) / total[0]) for i in span]
    return out


def llr(token: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios of a token's transitions."""
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    return let(
        _classes(token),
        lambda c: F.aggregate(
            F.sequence(F.lit(1), F.size(c) - 1),
            F.lit(0.0),
            lambda acc, i: acc + F.get(ratios, F.get(c, i - 1) * CLASSES + F.get(c, i)),
        ),
    )


def find(docs: DataFrame, table: list[float], text_col: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """docs as struct doc, its text, and two arrays of spans (s, k, e): base, and more that the models add."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text_of(docs, text_col).alias("text"))
    text = F.col("text")
    d = d.select(
        "doc",
        "text",
        _spans(text, ASSIGN, 0, lambda v: F.length(v) >= 8, 2).alias("assign"),
        _spans(text, ACCESS, 1, lambda v: F.length(v) >= 16).alias("access"),
        # only runs of 32 or more match, which are the same as the long ones among all runs
        _spans(text, HEX.replace("+", "{32,}"), 2, lambda v: F.length(v) >= 32).alias("hex"),
        _spans(
            text,
            CANDIDATE,
            3,
            lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (llr(v, table) >= min_llr),
        ).alias("random"),
    )
    d = d.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    # of all spans in order: how far base spans reach before each, and where the next base span starts
    far = F.lit(1 << 40)
    zero = F.lit(0).cast("long")

    def apart(spans: Column) -> Column:
        """Random spans that no base span reaches into and before which none starts that they reach."""
        before = running_maxima(F.transform(spans, lambda x: F.when(x.k < 3, x.e).otherwise(zero)))
        after = F.reverse(running_maxima(F.reverse(F.transform(spans, lambda x: F.when(x.k < 3, far - x.s).otherwise(zero)))))
        free = lambda b, a: F.filter(spans, lambda x, i: (x.k == 3) & (F.get(b, i) <= x.s) & (far - F.get(a, i) >= x.e))
        return let(before, lambda b: let(after, lambda a: free(b, a)))

    # let: an expression inside a function of an array would be computed for every element
    some = F.size("random") > 0
    return d.withColumn("more", F.when(some, let(F.sort_array(F.concat("base", "random")), apart)).otherwise(_none()))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))))


def scan(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    if table is None:
        table = train(samples(docs.sparkSession, docs, text_col, id_col))
    found = find(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), table)
    return found.select(
        "doc.doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", table: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span of the text, overlapping ones merged, replaced by mark; n_chars follows where there is one.

    Null texts stay null.
    """
    if table is None:
        table = train(samples(docs.sparkSession, docs, text_col))
    d = find(docs, table, text_col).withColumn("all", F.sort_array(F.concat("base", "more")))
    whole = F.col("text")
    cut = lambda a, b: F.substr(whole, (a + 1).cast("int"), (b - a).cast("int"))

    def clean_text(spans: Column, ends: Column) -> Column:
        """ends: furthest end before each span, 0 first. A span that starts at or after it opens a gap to copy."""
        parts = F.transform(
            spans,
            lambda x, i: F.when((x.s > F.get(ends, i)) | (i == 0), F.concat(cut(F.get(ends, i), x.s), F.lit(mark)))
            .when(x.s == F.get(ends, i), F.lit(mark)),
        )
        return F.concat(F.concat_ws("", F.filter(parts, lambda p: p.isNotNull())), cut(F.element_at(ends, -1), F.length(whole).cast("long")))

    reach = lambda spans: F.concat(F.array(F.lit(0).cast("long")), running_maxima(F.transform(spans, lambda x: x.e)))
    clean = let(F.col("all"), lambda spans: let(reach(spans), lambda ends: clean_text(spans, ends)))
    d = d.withColumn("clean", F.when(F.size("all") > 0, clean).otherwise(F.col(f"doc.`{text_col}`")))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            changed = F.when(F.size("all") > 0, F.length("clean").cast(docs.schema[c].dataType))
            out.append(changed.otherwise(F.col("doc.n_chars")).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return d.select(*out)
