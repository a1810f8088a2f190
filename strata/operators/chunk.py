"""Chunking: page markers, front matter, sections with chapters, content types, parents and children, chunks by bytes.

Section and type rules are built-in expressions. Splitting that carries state along a text runs in Arrow-batched mapInArrow,
one document at a time, without a shuffle; it is linear in a text but for a binary search for each chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of headings, table-of-contents lines, covers and content types.
HEADING = (
    "^\\s*#{1,6}\\s+\\S|^\\s*第\\s*[一二三四五六七八九十百零\\d]+\\s*[章节单元课篇讲]|^\\s*\\d{1,2}\\s*\\.\\s*\\d{1,2}\\s+\\S|^\\s*\\d{1,2}\\s*[.、]\\s*\\S|"
    "^\\s*[（(]\\s*[一二三四五六七八九十\\d]+\\s*[)）]|^\\s*(例题|练习|习题|思考与讨论|做一做|实验|本节小结|章末|复习|阅读|拓展|探究|活动|科学漫步|STSE)"
)
CHAPTER = "^\\s*(第\\s*[一二三四五六七八九十百零\\d]+\\s*章[^\\n]{0,20})"
PAGE_MARKER = "\\[\\[PAGE:(\\d{1,4})\\]\\]"
TOC_LINE = "^(第\\s*[一二三四五六七八九十百零\\d]+\\s*[章节单元课篇]|\\d{1,2}(\\.\\d{1,2})*\\s*[.、]?\\s*\\S)"
COVER = "ISBN|版权所有|人民教育出版社|出版发行|定价|教材\\s*$|普通高中教科书"
TYPES = (
    ("example", "(?m)例题|【例|^\\s*例\\s*\\d", 80), ("exercise", "练习|习题|思考与讨论|做一做|章末|复习题|本节小结|课后作业", 80),
    ("figure_caption", "^\\s*(图|表)\\s*[\\d一二三四五六七八九十]", 80), ("definition", "定义|叫做|称为|是指|定义为|的含义是|概念", 300),
    ("theorem", "定律|定理|原理|公式|规律|推论", 300),
)


def is_heading(line: Column) -> Column:
    return (F.length(F.trim(line)) > 0) & (F.length(F.trim(line)) <= 40) & line.rlike(HEADING)


def chapter_of(line: Column) -> Column:
    """The chapter that a heading names; null for other lines."""
    return F.nullif(F.trim(F.regexp_extract(line, CHAPTER, 1)), F.lit(""))


def sections(docs: DataFrame, heading=is_heading, chapter=chapter_of) -> DataFrame:
    """chunk_id, section, title, chapter, start (offset in the text), n_lines, n_chars of the stretches between headings.

    The chapter is that of the last heading before or at the section that names one. Lines and their offsets are made within the
    row; windows go by document.
    """
    lines = docs.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("chunk_id").orderBy("i")
    at = F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.coalesce(at, F.lit(0))).withColumn("h", heading(F.col("line")).cast("int"))
    named = F.when(F.col("h") == 1, chapter(F.col("line")))
    lines = lines.withColumn("section", F.sum("h").over(upto)).withColumn("chapter", F.last(named, ignorenulls=True).over(upto))
    return lines.groupBy("chunk_id", "section").agg(
        F.max(F.when(F.col("h") == 1, F.trim("line"))).alias("title"), F.max("chapter").alias("chapter"), F.min("at").cast("long").alias("start"),
        F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"),
    )


def page_markers(docs: DataFrame) -> DataFrame:
    """chunk_id, clean (the text without page markers) and markers: array of (page, start in the clean text)."""
    parts = F.split("text", PAGE_MARKER)
    pages = F.regexp_extract_all("text", F.lit(PAGE_MARKER), F.lit(1))
    ends = F.aggregate(
        F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(x))),
    )
    made = F.transform(F.arrays_zip(pages.alias("p"), ends.alias("e")), lambda x: F.struct(x["p"].cast("int").alias("page"), x["e"].alias("start")))
    return docs.select("chunk_id", F.array_join(parts, "").alias("clean"), F.coalesce(made, F.array().cast("array<struct<page:int,start:int>>")).alias("markers"))


def front_matter(docs: DataFrame) -> DataFrame:
    """chunk_id, body and meta: key: value lines between a first and a second ``---``; without both the text is the body."""
    parts = F.split("text", "---", 3)
    fenced = F.col("text").startswith("---") & (F.size(parts) == 3)
    pairs = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.contains(":"))
    entry = F.transform(pairs, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"),
        F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), "^[\"']+|[\"']+$", "").alias("value"),
    ))
    # of repeated keys the last stays
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda o: o.key == e.key))
    return docs.select(
        "chunk_id", F.when(fenced, F.trim(F.get(parts, F.lit(2)))).otherwise(F.col("text")).alias("body"),
        F.when(fenced, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"),
    )


def looks_like_toc(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hits = F.filter(lines, lambda x: (F.length(x) <= 24) & ~x.endswith("。") & x.rlike(TOC_LINE))
    return (F.size(lines) >= 5) & (F.size(hits) >= 0.6 * F.size(lines))


def content_type(text: Column, first: Column | None = None) -> Column:
    first = F.lit(False) if first is None else first
    out = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "body").when(looks_like_toc(text), "toc")
    out = out.when(first & (F.length(text) < 300) & F.substring(text, 1, 300).rlike(COVER), "cover")
    for name, p, n in TYPES:
        out = out.when(F.substring(text, 1, n).rlike(p), name)
    return out.otherwise("body")


_ENDS = re.compile(r"[。！？；…]+[”’」』）)]*|[.!?]\s+")
_BLANK = re.compile(r"\n\s*\n+")


def sentence_ends(text: str) -> list[int]:
    """Places after sentences and before blank lines."""
    return sorted({m.end() for m in _ENDS.finditer(text)} | {m.start() for m in _BLANK.finditer(text)})


def _between(text: str, start: str, end: str) -> Iterator[tuple[int, int]]:
    """Stretches from each start to the next end; what is not closed is none."""
    at = text.find(start)
    while at >= 0:
        close = text.find(end, at + len(start))
        if close < 0:
            return
        yield at, close + len(end)
        at = text.find(start, close + len(end))


#: Fixed patterns: a dollar formula, inline code, and a power beside an operator, which stands for its whole sentence.
_DOLLAR, _CODE = re.compile(r"\$[^$]+\$"), re.compile(r"`[^`]+`")
_POWER = re.compile(r"[a-zA-Z]\s*[²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀^]\s*[+\-=]")
_STOP = re.compile(r"[.\n?!]")


def protected(text: str) -> list[tuple[int, int]]:
    """Regions of formulas and code that no chunk may cut, in order; overlapping or touching ones are one."""
    found = [r for a, b in (("$$", "$$"), ("\\[", "\\]"), ("```", "```")) for r in _between(text, a, b)]
    found += [r for r in _between(text, "\\(", "\\)") if "\n" not in text[slice(*r)]]
    found += [m.span() for p in (_DOLLAR, _CODE) for m in p.finditer(text)]
    stops = [m.start() for m in _STOP.finditer(text)]
    for m in _POWER.finditer(text):
        before, after = bisect_left(stops, m.start()), bisect_left(stops, m.end())
        found.append((stops[before - 1] + 1 if before else 0, stops[after] if after < len(stops) else len(text)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def pieces(text: str, size: int = 384, overlap: int = 38, least: int = 100) -> list[tuple[int, int]]:
    """Overlapping chunks of about size characters: to the last sentence end, else the last space, outside of protected regions.

    A region that a chunk's end falls into is kept whole, so a chunk can be longer. Texts under least characters are one chunk;
    shorter stretches between are left out.
    """
    n = len(text)
    if n < least:
        return [(0, n)]
    regions, ends = protected(text), sentence_ends(text)
    opened = [a for a, _ in regions]

    def region(place: int) -> tuple[int, int] | None:
        k = bisect_right(opened, place) - 1
        return regions[k] if k >= 0 and place <= regions[k][1] else None

    out: list[tuple[int, int]] = []
    at = 0
    while at < n:
        stop = at + size
        if stop >= n:
            out.append((at, n))
            break
        if held := region(stop):
            stop = held[1]
        cut, k = stop, bisect_right(ends, stop) - 1
        while k >= 0 and ends[k] > at:
            held = region(ends[k])
            if not held:
                cut = ends[k]
                break
            # no place inside the region will do
            k = bisect_left(ends, held[0]) - 1
        if cut == stop:
            space = text.rfind(" ", at, stop)
            while space > at and (held := region(space)):
                space = text.rfind(" ", at, held[0])
            cut = space if space > at else cut
        if len(text[at:cut].strip()) >= least:
            out.append((at, cut))
        cut = cut if cut > at else at + size
        back = cut - overlap
        if back <= (out[-1][0] if out else 0):
            back = cut
        at = back if back > at else at + max(1, size // 2)
    return out


def windows(text: str, size: int, most: int) -> list[tuple[int, int]]:
    """One stretch if text has at most most characters, else stretches of at most size that end at sentences where one does."""
    if len(text) <= most:
        return [(0, len(text))]
    ends, out, at = sentence_ends(text), [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            k = bisect_right(ends, stop) - 1
            stop = ends[k] if k >= 0 and ends[k] > at else stop
        out.append((at, min(stop, len(text))))
        at = stop
    return out


_HEADING, _CHAPTER, _COVER = re.compile(HEADING), re.compile(CHAPTER), re.compile(COVER)
_TOC_LINE, _TYPES = re.compile(TOC_LINE), [(name, re.compile(p), n) for name, p, n in TYPES]


def type_of(text: str, first: bool = False) -> str:
    """The rules of content_type, for one text."""
    if not text.strip():
        return "body"
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    toc = sum(len(x) <= 24 and not x.endswith("。") and bool(_TOC_LINE.search(x)) for x in lines)
    if len(lines) >= 5 and toc >= 0.6 * len(lines):
        return "toc"
    if first and len(text) < 300 and _COVER.search(text):
        return "cover"
    return next((name for name, p, n in _TYPES if p.search(text[:n])), "body")


class Parent(NamedTuple):
    title: str
    chapter: str
    content_type: str
    start: int
    text: str


def grouped(text: str, target: int = 1400, most: int = 1800) -> list[Parent]:
    """Parents: sections are put together up to target characters; a longer one is cut at sentence ends."""
    places, titles, at = [0], [""], 0
    for line in text.split("\n"):
        if 0 < len(line.strip()) <= 40 and _HEADING.search(line):
            places.append(at)
            titles.append(line.strip())
        at += len(line) + 1
    groups: list[list] = []
    chapter = ""
    for title, a, b in zip(titles, places, [*places[1:], len(text)], strict=True):
        if m := _CHAPTER.search(title):
            chapter = m[1].strip()
        own = text[a:b].strip()
        if not own:
            continue
        if groups and len(groups[-1][4]) + len(own) <= target:
            groups[-1][4] += "\n" + own
        else:
            groups.append([title, chapter, type_of(own, not groups), a, own])
    return [
        Parent(title, chapter, kind if kind != "body" else type_of(whole[a:b].strip()), start + a, whole[a:b].strip())
        for title, chapter, kind, start, whole in groups for a, b in windows(whole, target, most) if whole[a:b].strip()
    ]


def _split(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(id, text) gives rows of schema, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                piece = b.slice(i, 256)
                rows = [r for d, x in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for r in make(d, x or "")]
                if rows:
                    names = [x.split()[0] for x in schema.split(", ")]
                    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("chunk_id").cast("long"), "text").mapInArrow(run, schema)


def parents(docs: DataFrame, target: int = 1400, most: int = 1800) -> DataFrame:
    """chunk_id, parent, title, chapter, content_type, start, text: sections put together to about target characters.

    Null and empty texts have none; start is the place of the group's first section, or of the window in it.
    """
    make = lambda d, x: [(d, i, *p) for i, p in enumerate(grouped(x, target, most))]
    return _split(docs, make, "chunk_id long, parent int, title string, chapter string, content_type string, start long, text string")


def children(docs: DataFrame, size: int = 384, least: int = 120, overlap: float = 0.1, target: int = 1400, most: int = 1800) -> DataFrame:
    """chunk_id, parent, child, title, chapter, content_type, start, stop, text: overlapping pieces of each parent.

    Pieces under least characters are left out: the parent holds their text.
    """

    def make(d, x):
        child = 0
        for i, p in enumerate(grouped(x, target, most)):
            for a, b in pieces(p.text, size, int(size * overlap)):
                own = p.text[a:b].strip()
                if len(own) >= least:
                    kind = p.content_type if p.content_type != "body" else type_of(own)
                    yield d, i, child, p.title, p.chapter, kind, p.start + a, p.start + b, own
                    child += 1

    kinds = "chunk_id long, parent int, child int, title string, chapter string, content_type string, start long, stop long, text string"
    return _split(docs, make, kinds)


def sentences(docs: DataFrame) -> DataFrame:
    """chunk_id, sentence, start, text."""

    def make(d, x):
        cuts = [0, *[e for e in sentence_ends(x) if 0 < e < len(x)], len(x)]
        return [(d, i, a, x[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if x[a:b].strip()]

    return _split(docs, make, "chunk_id long, sentence int, start long, text string")


_PARAGRAPH = re.compile(r"\n\s*\n")


def by_bytes(docs: DataFrame, most: int = 2048) -> DataFrame:
    """chunk_id, part, text of at most so many UTF-8 bytes: paragraphs are put together, longer ones cut at sentences, then characters."""

    def hard(x: str) -> Iterator[str]:
        held, size = [], 0
        for c in x:
            n = len(c.encode("utf-8", "replace"))
            if size + n > most:
                yield "".join(held)
                held, size = [], 0
            held.append(c)
            size += n
        if held:
            yield "".join(held)

    def units(x: str) -> Iterator[tuple[str, str]]:
        """Texts that fit, and what joins each to the one before."""
        for p in filter(None, (y.strip() for y in _PARAGRAPH.split(x))):
            if len(p.encode("utf-8", "replace")) <= most:
                yield "\n\n", p
                continue
            cuts = [0, *[e for e in sentence_ends(p) if 0 < e < len(p)], len(p)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for h, own in enumerate(hard(p[a:b])):
                    yield "\n\n" if k == h == 0 else "", own

    def make(d, x):
        out: list[str] = []
        size = 0
        for glue, own in units(x):
            n = len(own.encode("utf-8", "replace"))
            if out and size + len(glue) + n <= most:
                out[-1] += glue + own
                size += len(glue) + n
            else:
                out.append(own)
                size = n
        return [(d, i, p) for i, p in enumerate(out)]

    return _split(docs, make, "chunk_id long, part int, text string")
