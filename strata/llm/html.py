"""Main text of web pages: site templates found by counting element subtrees per host, and boilerplate elements.

A page is parsed in one pass into text blocks and elements. Every element subtree is hashed bottom-up: an element's hash is
that of its tag and of the hashes of its texts and child elements in order; attributes do not count. Spark counts, per host,
the distinct articles on whose pages the hash of a block element occurs. Subtrees on at least MIN_PAGES articles and SHARE of a
host's are its templates, and on hosts of any size those on at least FEW_PAGES articles and FEW_SHARE of the host's; they are
deleted. Articles, not pages, are counted: a text that a site carries in a hundred copies is no template. What is never article
text on any site goes by its tag (LEFT_OUT) or by the words of its class and id (NAMES; inside an article only OWN_NAMES).

Scale: two scans of the pages. The first emits distinct (host, hash, article) rows, reduced map-side before the shuffle; a
page's own hashes bound a host's templates to 1 / SHARE times the mean subtrees of a page. The second parses again and
deletes; the templates table joins by host (broadcast only if its file is below Spark's threshold; else a sort-merge join
that adaptive execution splits). Parsing takes time in proportion to a page's length, whatever its markup.

Cases: null and empty html give an empty text; a null url is host ''; null ids stay null; repeated pages have one row each;
broken markup (unclosed or stray tags, a comment or tag without end, thousands of nested elements) is read as browsers do,
roughly; very long pages stay whole; an empty table gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

import html as references
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialise, slices

MIN_PAGES, SHARE = 20, 0.5
#: Few articles can share text by chance: there a template is what nearly all have.
FEW_PAGES, FEW_SHARE = 3, 0.8

#: Fixed names of HTML: elements without content, whose content is raw, that start a block, and that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "nav header footer aside form script style noscript template iframe svg button select textarea head title dialog menu".split()
)
#: Words of class and id values that name what is no article text.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu "
    "nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Whole class or id values that do so inside an article, on DIVISIONS only.
OWN_NAMES = frozenset("ad ads advert adverts advertisement comments cookie-notice disqus newsletter sponsored".split())
DIVISIONS = frozenset("div section ul ol span ins aside".split())
ARTICLE = frozenset(("article", "main"))
#: End tags inside these do not close what is open outside of them.
BARRIERS = frozenset("body article main table td th".split())
#: What the start of an element closes, and the elements up to which that reaches.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: The rest of a tag. A quote matters only after an equals sign, as for browsers; every step is possessive.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Page:
    """Blocks (text, element number), and elements: parent, tag, digest (0 for one without text)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int]] = []
        self.parent, self.tag, self.digest = [-1], [""], [0]
        self._stack, self._out, self._inside, self._parts = [0], [False], [False], [array("Q")]
        self._at: dict[str, list[int]] = defaultdict(list)
        self._barriers, self._text = [0], []
        self._read(html)
        self._end_block()
        while len(self._stack) > 1:
            self._pop()

    def _end_block(self) -> None:
        if self._text:
            if text := _SPACE.sub(" ", "".join(self._text)).strip():
                self.blocks.append((text, self._stack[-1]))
            self._text = []

    def _add(self, text: str) -> None:
        if "&" in text:
            text = references.unescape(text)
        if not self._out[-1]:
            self._text.append(text)
        if told := " ".join(text.split()):
            self._parts[-1].append(xxhash.xxh64_intdigest(told.encode("utf-8", "replace")))

    def _left_out(self, tag: str, attributes: str) -> bool:
        inside = self._inside[-1]
        if tag in LEFT_OUT:
            return not (inside and tag == "header")
        if not attributes or tag in ("html", "body", "article", "main"):
            return False
        for a, b, c in _ATTRIBUTE.findall(attributes):
            values = (a or b or c).lower().split()
            if inside:
                if tag in DIVISIONS and not OWN_NAMES.isdisjoint(values):
                    return True
            elif any(not NAMES.isdisjoint(re.split("[-_]", v)) for v in values):
                return True
        return False

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            limit = max([self._at[t][-1] for t in until if self._at[t]], default=0)
            for t in closed:
                if self._at[t] and self._at[t][-1] > limit:
                    self._close(t)
        if tag in BLOCK:
            if tag != "br" and self._at["p"]:
                self._close("p")
            self._end_block()
        if tag in VOID:
            return
        self._at[tag].append(len(self._stack))
        if tag in BARRIERS:
            self._barriers.append(len(self._stack))
        self._out.append(self._out[-1] or self._left_out(tag, attributes))
        self._inside.append(self._inside[-1] or tag in ARTICLE)
        self._stack.append(len(self.tag))
        self._parts.append(array("Q"))
        self.parent.append(self._stack[-2])
        self.tag.append(tag)
        self.digest.append(0)

    def _pop(self) -> None:
        e, parts = self._stack[-1], self._parts.pop()
        tag = self.tag[e]
        if tag in BLOCK:
            self._end_block()
        if parts:
            told = self.digest[e] = xxhash.xxh64_intdigest(tag.encode("utf-8", "replace") + b"\x1e" + parts.tobytes())
            self._parts[-1].append(told)
        self._stack.pop()
        self._out.pop()
        self._inside.pop()
        self._at[tag].pop()
        if tag in BARRIERS:
            self._barriers.pop()

    def _close(self, tag: str) -> None:
        """Close the innermost open element of the tag, with all in it, unless it lies outside of a barrier."""
        if tag in BLOCK:
            self._end_block()
        places = self._at[tag]
        if places and (tag in BARRIERS or places[-1] > self._barriers[-1]):
            to = places[-1]
            while len(self._stack) > to:
                self._pop()

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            start = html.find("<", at)
            if start < 0:
                self._add(html[at:])
                return
            if start > at:
                self._add(html[at:start])
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                at = end if close < 0 else close + 3
                continue
            ending = html.startswith("/", start + 1)
            name = _NAME.match(html, start + 1 + ending)
            if not name:
                if ending or html.startswith(("!", "?"), start + 1):
                    close = html.find(">", start)
                    at = end if close < 0 else close + 1
                else:
                    self._add("<")
                    at = start + 1
                continue
            rest = _REST.match(html, name.end())
            if not rest:
                # a tag without end: browsers drop what follows
                return
            at, tag = rest.end(), name[0].lower()
            if ending:
                self._close(tag)
                continue
            self._open(tag, rest[0][:-1])
            if tag in RAW:
                close = _RAW_ENDS[tag].search(html, at)
                at = close.start() if close else end
                if close and (rest := _REST.match(html, close.end())):
                    at = rest.end()
                self._close(tag)

    def subtrees(self) -> dict[int, int]:
        """Hash (a signed long) by element, of block elements and those left out by tag that have text."""
        return {
            e: d - (1 << 63) for e, d in enumerate(self.digest) if d and e and (self.tag[e] in BLOCK or self.tag[e] in LEFT_OUT) and self.tag[e] not in ("html", "body")
        }

    def kept(self, templates: frozenset[int] = frozenset()) -> tuple[list[str], int]:
        """The blocks that stay, and the number of outermost elements deleted as templates."""
        if not templates:
            return [t for t, _ in self.blocks], 0
        found = self.subtrees()
        gone, n = [False] * len(self.tag), 0
        for e in range(1, len(gone)):
            gone[e] = gone[self.parent[e]]
            if not gone[e] and found.get(e) in templates:
                gone[e] = True
                n += 1
        return [t for t, e in self.blocks if not gone[e]], n


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, hash, article: of every subtree; and one row per page with hash null."""
    for piece in slices(batches, 1):
        hosts, hashes, articles = [], [], []
        for host, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            page = Page(html)
            article = xxhash.xxh64_intdigest(" ".join(page.kept()[0]).encode("utf-8", "replace")) - (1 << 63)
            own = set(page.subtrees().values())
            hosts += [host] * (1 + len(own))
            hashes += [None, *own]
            articles += [article] * (1 + len(own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(articles, pa.int64())], names=["host", "hash", "article"]
        )


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hashes): the template subtrees of each host that has some."""
    rows = _pages(pages).select("host", "html").mapInArrow(_subtrees, "host string, hash long, article long").distinct()
    counted = rows.groupBy("host", "hash").agg(F.count("*").alias("n"))
    total = counted.filter("hash is null").select("host", F.col("n").alias("articles"))
    often = counted.filter(F.col("hash").isNotNull() & (F.col("n") >= min(min_pages, FEW_PAGES)))
    found = often.join(total, "host").filter(
        ((F.col("n") >= min_pages) & (F.col("n") >= F.lit(share) * F.col("articles")))
        | ((F.col("n") >= FEW_PAGES) & (F.col("n") >= F.lit(FEW_SHARE) * F.col("articles")))
    )
    return materialise(found.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "html-templates")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple, frozenset[int]] = {}
    for piece in slices(batches, 3):
        hosts, known = piece.column(2).to_pylist(), piece.column(4).to_pylist()
        texts, removed = [], []
        for host, html, hashes in zip(hosts, piece.column(3).to_pylist(), known, strict=True):
            if host not in memo:
                if len(memo) > 1000:
                    memo.clear()
                memo[host] = frozenset(hashes or ())
            kept, n = Page(html).kept(memo[host])
            texts.append(" ".join(kept))
            removed.append(n)
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).cast(pa.int64()), piece.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_templates"],
        )


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_templates (outermost elements deleted as site templates) of every page."""
    joined = _pages(pages).join(templates(pages, min_pages, share), "host", "left")
    return joined.select("page_id", "url", "host", "html", "hashes").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, n_templates long"
    )
