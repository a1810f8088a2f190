"""Text measures as column expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A comparison unit, a run of Han characters, a Latin word, and the characters that count as wide.
UNIT = "[\u4e00-\u9fff]|[a-z0-9_]+"
HAN_RUN = "[\u4e00-\u9fff]+"
LATIN_WORD = "[a-zA-Z][a-zA-Z0-9_]{1,}"
WIDE = "[\u4e00-\u9fff\u3400-\u4dbf\u3000-\u303f\uff00-\uffef]"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def units(text: Column) -> Column:
    """The set of comparison units: each Han character, each lower-case Latin word or number."""
    return F.array_distinct(unit_list(text))


def unit_list(text: Column) -> Column:
    return all_matches(F.lower(F.coalesce(text, F.lit(""))), UNIT)


def unit_length(text: Column) -> Column:
    """Units with multiplicity."""
    return F.size(unit_list(text))


def bigrams(text: Column) -> Column:
    """The set of Han bigrams (a lone character counts) and Latin words."""
    text = F.coalesce(text, F.lit(""))
    pairs = F.flatten(
        F.transform(
            all_matches(text, HAN_RUN),
            lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(
                F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
            ),
        )
    )
    return F.array_distinct(F.concat(pairs, all_matches(F.lower(text), LATIN_WORD)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the set a that is in b; 1 if a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def estimate_tokens(text: Column, wide: float = 1.0, narrow: float = 0.30) -> Column:
    text = F.coalesce(text, F.lit(""))
    n_narrow = F.length(F.regexp_replace(text, WIDE, ""))
    n_wide = F.length(text) - n_narrow
    return F.floor(n_wide * F.lit(float(wide)) + n_narrow * F.lit(float(narrow)) + 0.5).cast("int")


def squeezed(text: Column) -> Column:
    """Text without any white space, for exact comparison."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[\\s\u3000]+", "")


def squeezed_hash(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\x0b\\f\\r]+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Fixed value: what a question has in front of it when it is turned into a vector; passages have nothing.
QUERY_INSTRUCTION = "为这个句子生成表示以用于检索相关文章："


def embedding_input(text: Column, question: bool = False) -> Column:
    """The text that a model is given; null where there is none, which has a zero vector."""
    given = F.concat(F.lit(QUERY_INSTRUCTION), text) if question else text
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", given)


def unit_vector(vec: Column, size: int) -> Column:
    """A vector of length one; zeros for a missing vector, one of another size or one without length."""
    length = F.sqrt(dot(vec, vec))
    fine = (F.size(vec) == size) & (length > 0)
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.coalesce(F.when(fine, F.transform(vec, lambda x: x.cast("double") / length)), zeros)


#: Letters that mathematical fonts are mapped to by mistake, symbols likewise, pieces of large brackets that go,
#: and ranges of noise.
GLYPHS = (
    "犃犅犆犇犈犉犌犎犐犑犓犔犕犖犗犘犙犚犛犜犝犞犠犡犢犣犪犫犮犱犲犳犵犺犻犼犽犾犿狀狆狇狉狊狋狌狏狑狓狔狕槡瓚狘\ue010\ue011\ue012\ue01b\ue02f\ue03c",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnpqrstuvwxyz√∥|.-*⊂∀⇒",
)
GLYPHS_DROPPED = "烄烅烆熿燀燄燅"
GLYPH_NOISE = (
    "[\ue000-\uf8ff\u0400-\u04ff\u0530-\u058f\u0590-\u05ff\u0600-\u06ff\u0b80-\u0dff\u0e00-\u0e7f\u10a0-\u10ff]"
)


def fix_glyphs(text: Column) -> Column:
    """Map misread glyphs to their characters, after a space where one follows a backslash command, and drop noise."""
    spaced = F.regexp_replace(text, f"(\\\\[A-Za-z]*)([{GLYPHS[0]}])", "$1 $2")
    mapped = F.translate(spaced, GLYPHS[0] + GLYPHS_DROPPED, GLYPHS[1])
    return F.when(has_glyph_issue(text), F.regexp_replace(mapped, GLYPH_NOISE, "")).otherwise(text)


def has_glyph_issue(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{GLYPHS[0]}{GLYPHS_DROPPED}]|{GLYPH_NOISE}"), F.lit(False))


def truncate(text: Column, most: int) -> Column:
    """White space made single; at most so many characters, cut after the last sentence end past half of them."""
    flat = one_space(text)
    cut = F.substring(flat, 1, most)
    places = [F.when(F.instr(cut, x) > 0, F.length(cut) - F.instr(F.reverse(cut), x)).otherwise(F.lit(-1)) for x in ("。", ".", "？", "?")]
    at = F.greatest(*places)
    return F.when(F.length(flat) <= most, flat).when(at > most * 0.5, F.substr(cut, F.lit(1), at + 1)).otherwise(cut)


#: Fixed pattern: a Han concept of 2 to 8 characters, a copula, a number and perhaps a power of ten.
CLAIM = (
    "([\u4e00-\u9fff]{2,8})\\s*(?:为|是|＝|=|约为|约)\\s*(\\d+(?:\\.\\d+)?)"
    "(?:\\s*(?:[×xX*]\\s*10|10\\s*[×xX*])\\s*[⁻\\-]?\\s*(\\d+)|\\s*[eE]\\s*[-−]?\\s*(\\d+))?"
)


def numeric_claims(text: Column) -> Column:
    """Array of (concept, value) claims; a captured exponent counts as negative."""
    part = lambda k: F.regexp_extract_all(text, F.lit(CLAIM), F.lit(k))
    rows = F.arrays_zip(part(1).alias("c"), part(2).alias("b"), part(3).alias("m"), part(4).alias("e"))
    exponent = lambda x: F.when(x["m"] != "", x["m"]).when(x["e"] != "", x["e"])
    return F.array_distinct(
        F.transform(
            rows,
            lambda x: F.struct(
                x["c"].alias("concept"),
                F.concat(x["b"], F.coalesce(F.concat(F.lit("e-"), exponent(x)), F.lit(""))).alias("value"),
            ),
        )
    )
