"""Personal data: four fixed patterns, and identifiers that bootstrapped contexts discover.

Base spans are the matches of the patterns and the first seeds. The words around a seed are lexical patterns (two words before;
one before and one after), and identifier-shaped numbers between the base spans are unseen instances. Spark scores the graph of
patterns and instances per kind in rounds: a pattern by the mean score of its instances (first seeds are 1) with one more
instance of score 0, an instance by the noisy-or of the accepted patterns it stands in. A pattern is accepted with at least
MIN_SEEDS different seeds and a score of MIN_SCORE; an instance of score SEED_SCORE is a seed of the next round and induces
patterns of its own. Scores never fall; the rounds end when they stand still (ROUNDS at most). What stands in
an accepted pattern is added as a span of the seeds' kind.

Scale: one scan finds spans and contexts and writes them, without texts, as a table; the graph is made of rows already summed
by (kind, pattern, instance) before they are shuffled, and holds only patterns of MIN_SEEDS instances. The driver sees a
count and a sum a round.

Cases: a null text is empty; null ids stay null; repeated rows are told apart by a row number in that table; spans of one
kind never overlap and ties do not arise within a kind; very long texts are scanned whole in linear time; an empty table
gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialise, slices, text_of

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_SCORE, SEED_SCORE, ROUNDS = 3, 0.6, 0.5, 10

#: The contract's patterns. Runs are possessive and start where a run starts, which changes no match but keeps them linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9][0-9().\x20-]*+")
#: Separators that end a number: doubled ones, but not those around brackets.
_DOUBLE = re.compile(r"\x20{2,}|-{2,}|\.{2,}|\.\x20|\x20-\x20")
#: Digits of an identifier.
LEAST, MOST = 7, 19
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern: each @ with the run of local characters before it, after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        # the run before @, found backwards; what a match has used is not part of it
        while start > end and _LOCAL_CHAR[ord(text[start - 1]) if ord(text[start - 1]) < 128 else 0]:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        # a run that ends at this @ cannot be part of a later match
        end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


_LOCAL_CHAR = [bool(_LOCAL.fullmatch(chr(i))) for i in range(128)]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Start and end of the base spans of each kind."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m[0].split(".")) and all(int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out[3].append(m.span())
    return out


def _digits(text: str) -> int:
    return sum(map(str.isdigit, text))


def numbers(run: str, separators: str = " ") -> Iterator[tuple[int, int]]:
    """Start and end of the identifiers of LEAST to MOST digits in a run of digits and separators.

    The run is cut at double separators, then between words that are numbers by themselves (and after one where all is too long); what is still longer than MOST
    digits is cut where its groups of digits repeat, and else as soon as the next group does not fit.
    """
    at = 0
    for m in [*_DOUBLE.finditer(run), None]:
        part = run[at : m.start() if m else len(run)]
        words = [(at + w.start(), at + w.end(), _digits(w[0])) for w in re.finditer(f"[^{re.escape(separators)}]+", part)]
        words = [w for w in words if w[2]]
        sizes = [w[2] for w in words]
        period, long = 0, sum(sizes) > MOST
        if long and len(set(sizes)) > 1:
            fits = (p for p in range(1, min(MOST, len(sizes) // 2) + 1) if LEAST <= sum(sizes[:p]) <= MOST and sizes[p:] == sizes[:-p])
            period = next(fits, 0)
        groups: list[list[tuple[int, int, int]]] = []
        held = 0
        for i, w in enumerate(words):
            apart = i % period == 0 if period else held + w[2] > MOST or (held >= LEAST and (w[2] >= LEAST or long and sizes[i - 1] >= LEAST))
            if apart or not groups:
                groups.append([])
                held = 0
            groups[-1].append(w)
            held += w[2]
        for group in groups:
            n, start, end = sum(w[2] for w in group), group[0][0], group[-1][1]
            if LEAST <= n <= MOST:
                yield start, end
            elif n > MOST and separators == " ":
                yield from ((start + a, start + b) for a, b in numbers(run[start:end], " ().-"))
        if m:
            at = m.end()


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Kind, start and end of identifier-shaped runs off the taken spans."""
    out, taken, i = [], sorted(taken), 0
    found = []
    free = 0
    for a, b in [*taken, (len(text), len(text))]:
        for m in _RUN.finditer(text, free, max(free, a)):
            for start, end in numbers(m[0]):
                run = m[0][start:end].lstrip("(). -")
                start = end - len(run)
                run = run.rstrip("(). -")
                dotted = run.count(".") == 3 and " " not in run
                found.append((start + m.start(), start + m.start() + len(run), 1 if dotted else 2 if _digits(run) >= 16 else 3))
        free = max(free, b)
    at = text.find("@")
    while at >= 0:
        a, b = max(0, at - 64), min(len(text), at + 65)
        start = max(a, at - len(text[a:at].split()[-1]) if text[a:at].split() and not text[at - 1].isspace() else at)
        after = text[at + 1 : b].split()
        end = at + 1 + (len(after[0]) if after and not text[at + 1].isspace() else 0)
        if start < at and end > at + 1:
            found.append((start, end, 0))
        at = text.find("@", end)
    last = 0
    for start, end, kind in sorted(found):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and not (i < len(taken) and taken[i][0] < end):
            out.append((kind, start, end))
            last = end
    return out


def contexts(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a span; none if no word stands before it."""
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-2:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 32])][:1]
    if not before:
        return []
    keys = [f"{kind}|L|{'|'.join(before)}", f"{kind}|B|{before[-1]}|{after[0] if after else ''}"]
    return [xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) - (1 << 63) for k in keys]


_ITEM = pa.struct(
    [("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]
)
_FOUND = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("items", pa.list_(_ITEM))]
)
_FOUND_SQL = (
    "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "items array<struct<kind:int,s:long,e:long,seed:boolean,instance:long,patterns:array<long>>>"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 36
    for piece in slices(batches, 1):
        rows = []
        for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, spans in enumerate(base) for s, e in spans)
            items = [(k, s, e, True) for k, spans in enumerate(base) for s, e in spans]
            items += [(k, s, e, False) for k, s, e in candidates(text, [x for spans in base for x in spans])]
            rows.append(
                {"rid": rid, "doc_id": doc_id}
                | {f"n_{k}": len(base[i]) for i, k in enumerate(KINDS)}
                | {
                    "base_sha256": hashlib.sha256(joined.encode()).hexdigest(),
                    "items": [
                        {"kind": k, "s": s, "e": e, "seed": seed,
                         "instance": xxhash.xxh64_intdigest(text[s:e].lower().encode("utf-8", "replace")) - (1 << 63),
                         "patterns": contexts(text, k, s, e)}
                        for k, s, e, seed in items
                    ],
                }
            )
            rid += 1
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of spans, unseen instances and their contexts: one row per document, without its text."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("t"))
    return materialise(d.mapInArrow(_find, _FOUND_SQL), "pii-found")


def score_patterns(
    found: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, seed_score: float = SEED_SCORE, rounds: int = ROUNDS
) -> DataFrame:
    """(kind, pattern, score) of the accepted patterns."""
    items = found.select(F.explode("items").alias("i")).select("i.kind", F.explode("i.patterns").alias("pattern"), "i.instance", "i.seed")
    edges = items.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("base"))
    # a pattern of fewer instances is never accepted
    often = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= min_seeds)
    edges = materialise(edges.join(often, ["kind", "pattern"]), "pii-graph")
    scored, known = edges.withColumn("score", F.col("base").cast("double")), None
    for _ in range(rounds):
        told = scored.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.first("n") + 1)).alias("p"), F.sum((F.col("score") >= seed_score).cast("int")).alias("seeds")
        )
        accepted = told.filter((F.col("seeds") >= min_seeds) & (F.col("p") >= min_score)).select("kind", "pattern", F.col("p").alias("score"))
        accepted = materialise(accepted, "pii-patterns")
        unseen = edges.filter(~F.col("base")).join(accepted, ["kind", "pattern"])
        unseen = unseen.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("score") * 0.95)))).alias("told"))
        unseen = materialise(unseen, "pii-instances")
        now = unseen.agg(F.count("*"), F.round(F.sum("told"), 3)).first()
        if now == known or not now[0]:
            break
        known = now
        scored = edges.join(unseen, ["kind", "instance"], "left").withColumn(
            "score", F.when(F.col("base"), 1.0).otherwise(F.coalesce("told", F.lit(0.0)))
        )
    return accepted


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document; options of score_patterns."""
    found = find(docs, id_col, text_col)
    accepted = score_patterns(found, **options)
    unseen = found.select("rid", F.explode(F.filter("items", lambda i: ~i.seed)).alias("i")).select(
        "rid", F.struct("i.kind", "i.s", "i.e").alias("x"), F.col("i.kind").alias("kind"), F.explode("i.patterns").alias("pattern")
    )
    added = unseen.join(accepted, ["kind", "pattern"], "left_semi").groupBy("rid").agg(F.collect_set("x").alias("added"))
    base = F.transform(F.filter("items", lambda i: i.seed), lambda i: F.struct(i.kind.alias("kind"), i.s.alias("s"), i.e.alias("e")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.sort_array(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:int,s:bigint,e:bigint>>"))))
    text = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.s.cast("string"), x.e.cast("string")))
    return found.join(added, "rid", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.concat_ws(",", text).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )
