"""Token counts by a map-side two-tier lookup, without shuffling pre-tokens.

Pass one: every task summarises the pieces of all its texts in one row of fixed size (Misra-Gries counters, its TASK_TOP most
frequent at last); summaries, never pre-tokens, are merged in a tree, FAN_IN at a time. The TABLE_TOP most frequent with their
token counts are a table of bounded size, sent to every worker. Pass two: each text is cut where this pre-tokenizer always cuts,
which is around white space; a piece is looked up in that table, then in the worker's cache of at most CACHE entries, and the
pieces missing in both are encoded together. Pieces longer than LONGEST characters are in neither, so both are bounded by bytes.
Texts that hold a special token's string are encoded whole by the library. The tables change speed only: every count is the
library's.

Cases: a null text is empty and has 0 tokens; null ids stay null; repeated rows are counted one by one; very long texts are
handled whole; ties in frequency are ordered by the piece; an empty table gives an empty result; other columns are not carried
along. A tokenizer other than those in PROVEN is refused: the cuts are known to be right for these only.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, text_of

TOKENIZER = "byte_bpe_50k.json"
PROVEN = frozenset({TOKENIZER})
TASK_TOP, TABLE_TOP, CACHE, LIMIT = 4096, 32768, 200_000, 1024
LONGEST, FAN_IN = 64, 16

#: White space as this pre-tokenizer has it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text without these has single spaces and line ends only, each before a word.
_IRREGULAR = re.compile(f"[^\\S \\n]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\Z")
#: Its cuts around white space: a run but for the character before a word; a word with one space before it; that character.
_CUT = re.compile(f"[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """A worker's tokenizer, one for each file and process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


_LOADED: dict = {}


def pieces(text: str) -> tuple[list[str], int] | None:
    """The pieces of a text, and the number of line ends that are left out. None: it may hold a special token.

    Of texts with regular white space the line ends are left out: each is one pre-token of one token there.
    """
    if "<|" in text:
        return None
    if _IRREGULAR.search(text):
        return _CUT.findall(text), 0
    # a space marks a piece that has one before it: the first piece of a line has none
    return text.replace(" ", "\n ").split("\n"), text.count("\n")


class Counts(dict):
    """Token counts of pieces: the frequent ones for good, others until more than limit are there."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int = CACHE):
        super().__init__(frequent)
        self.tok, self.frequent, self.limit = load(path), frequent, limit

    def learn(self, missing: list[str]) -> dict[str, int]:
        """Token counts of missing pieces, of which those that are not too long are remembered."""
        found = dict(zip(missing, [len(e.ids) for e in self.tok.encode_batch_fast(missing, add_special_tokens=False)], strict=True))
        if len(self) + len(found) > self.limit + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self.update(found)
        for p in [p for p in missing if len(p) > LONGEST]:
            del self[p]
        return found

    def count(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) if t else ([], 0) for t in texts]
        get = self.get
        found = [list(map(get, c[0])) if c else () for c in cut]
        gaps = [[i for i, n in enumerate(f) if n is None] if None in f else () for f in found]
        missing = {c[0][i] for c, g in zip(cut, gaps, strict=True) for i in g}
        fresh = self.learn(list(missing)) if missing else {}
        out = []
        for t, c, f, g in zip(texts, cut, found, gaps, strict=True):
            if c is None:
                out.append(len(self.tok.encode(t, add_special_tokens=False).ids))
                continue
            for i in g:
                f[i] = fresh[c[0][i]]
            out.append(sum(f) + c[1])
        return out


def shrink(counts: dict[str, int], most: int) -> dict[str, int]:
    """A Misra-Gries summary: all counts less that of the first one over most; what is left. Summaries can be added up."""
    if len(counts) <= most:
        return counts
    less = sorted(counts.values(), reverse=True)[most]
    return {w: n - less for w, n in counts.items() if n > less}


def _row(counts: dict[str, int], top: int, task: int) -> pa.RecordBatch:
    best = sorted(shrink(counts, top).items(), key=lambda x: (-x[1], x[0]))
    return pa.RecordBatch.from_pydict({"task": [task], "words": [[w for w, _ in best]], "n": [[n for _, n in best]]}, schema=_TOP)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for piece in slices(batches, 0):
        for t in piece.column(0).to_pylist():
            if c := pieces(t):
                seen.update(c[0] if max(map(len, c[0]), default=0) <= LONGEST else [w for w in c[0] if len(w) <= LONGEST])
        if len(seen) > 50 * TASK_TOP:
            seen = Counter(shrink(seen, 25 * TASK_TOP))
    yield _row(seen, TASK_TOP, TaskContext.get().partitionId())


_TOP = pa.schema([("task", pa.int32()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            total: Counter[str] = Counter()
            for s in row["s"]:
                for w, k in zip(s["words"], s["n"], strict=True):
                    total[w] += k
            yield _row(total, TABLE_TOP, row["g"])


def frequent_table(docs: DataFrame, text_col: str = "text", path: str | None = None) -> dict[str, int]:
    """The at most TABLE_TOP most frequent pieces of all documents, with their token counts."""
    kind = "task int, words array<string>, n array<long>"
    texts = docs.select(text_of(docs, text_col).alias("t"))
    left, tops = texts.rdd.getNumPartitions(), texts.mapInArrow(_summary, kind)
    while left > 1:
        groups = tops.groupBy(F.floor(F.col("task") / FAN_IN).cast("int").alias("g")).agg(F.collect_list(F.struct("words", "n")).alias("s"))
        left, tops = -(-left // FAN_IN), groups.mapInArrow(_merged, kind)
    rows = tops.collect()  # one row of TABLE_TOP words
    words = rows[0]["words"] if rows else []
    tok = load(path or tokenizer_path(TOKENIZER))
    return {w: len(e.ids) for w, e in zip(words, tok.encode_batch_fast(words, add_special_tokens=False), strict=True)}


def count_tokens(
    docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    if name not in PROVEN:
        raise ValueError(f"the cuts of pieces are not proven for {name}")
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text_col, tokenizer_path(name)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer_path(name), table.value)
        for piece in slices(batches, 1):
            n = pa.array(counts.count(piece.column(1).to_pylist()), pa.int64())
            size = pc.binary_length(piece.column(1)).cast(pa.int64())
            over = pc.greater(n, limit)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
