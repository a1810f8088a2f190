"""Hierarchical multi-length packing of documents into training sequences.

A document is its token ids and an end id. Pieces of the longest context are cut off documents that exceed it; what remains is
routed to the smallest of several context sizes (TIERS) that holds it. Each tier is packed by best fit into sequences of its
size; the gaps of the longest windows are then filled by sequences' worth of pieces from shorter tiers, longest first, and at
last by cutting one. What is left at a task's end is cut into lengths that are powers of two, which need no padding. Sequences
of one size are dealt to step groups of equal token counts over the whole table: STEP tokens each, but for the last of a size.

Scale: texts are not shuffled. Every task packs its own documents, POOL tokens at a time, with only those in memory; ids are
unique by task and number. A task that is run again reads the same rows in the same order, so it makes the same sequences. The
pieces, without texts, are a table in the shared folder; step groups continue from task to task by its counts, one row for each
task and size.

Cases: null and empty texts are one end id; null ids stay null and repeated rows are packed each; a very long text is cut
into whole windows; ties in length are ordered by document; an empty table gives an empty result; other columns are not
carried along. A tokenizer other than those in PROVEN is refused: the cuts below are known to be right for these only.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import SLICE_BYTES, SLICE_ROWS, materialise, slices, text_of
from strata.llm.tokens import load, tokenizer_path

TOKENIZER, END = "word_bpe_49k.json", 2
PROVEN = frozenset({TOKENIZER})
CONTEXT = 4096
TIERS = (512, 1024, 2048, 4096)
POOL, STEP, CACHE = 1 << 20, 16 * 4096, 350_000
#: Longer pieces, as in scripts without spaces, are not remembered: the cache is bounded by bytes.
LONGEST = 64
#: Plain words that are encoded as one text.
WORDS = 4096

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)

#: Marks that end a word and are never part of a contraction or a special token.
_MARKS = b".,!?;:#*$%&"


def _ends_in_letter(stem: bytes) -> bool:
    """Whether a stem that ends beyond ASCII ends in a Latin letter whose lower case is one letter: then a new pre-token follows.

    Other letters can become a letter and a mark when normalised, which would run on into what follows.
    """
    last = stem.decode("utf-8", "replace")[-1]
    return last < "\u0250" and last.isalpha() and len(last.lower()) == 1


_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


def _is_word(text: str) -> bool:
    """Whether a text is Latin letters only (without U+0130, whose lower case is two characters): one pre-token."""
    return bool(_LATIN.fullmatch(text))


class Ids(dict):
    """Ids of pieces between spaces and line ends, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its pieces in order.
    """

    def __init__(self, path: str, limit: int = CACHE):
        super().__init__({b"": b""})
        self.tok, self.limit, self.older = load(path), limit, {}
        names = self.tok.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """The ids of missing pieces: of the older generation, or encoded. A full generation becomes the older one.

        A letter followed by marks at a piece's end is a cut of this pre-tokenizer too, so a word is encoded once and its
        forms with punctuation are put together.
        """
        if len(self) + len(missing) > self.limit:
            self.older = dict(self)
            self.clear()
            self[b""] = b""
        older = self.older
        out = {m: older[m] for m in missing if m in older} if older else {}
        words, joined = set(), []
        for m in missing:
            if m in out:
                continue
            if m[-1] in _MARKS:
                stem = m.rstrip(_MARKS)
                if stem and (96 < stem[-1] < 123 or stem[-1] > 127 and _ends_in_letter(stem)):
                    marks = m[len(stem) :]
                    joined.append((m, stem, marks))
                    for part in (stem, marks):
                        if part not in out:
                            if (known := self.get(part) or older.get(part)) is None:
                                words.add(part)
                            else:
                                out[part] = known
                    continue
            words.add(m)
        wanted = list(words.difference(out))
        texts = [m.decode("utf-8", "replace") for m in wanted]
        plain = [_is_word(t) for t in texts]
        out.update(self._words(list(compress(wanted, plain)), list(compress(texts, plain))))
        wanted, texts = [m for m in wanted if m not in out], [t for m, t in zip(wanted, texts, strict=True) if m not in out]
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        out.update(zip(wanted, [array("I", e.ids).tobytes() for e in found], strict=True))
        out.update([(m, out[stem] + out[marks]) for m, stem, marks in joined])
        self.update(out)
        return out

    def _words(self, words: list[bytes], texts: list[str]) -> dict[bytes, bytes]:
        """Ids of words that are one pre-token each: encoded as one text, cut after the ids that end a word."""
        out = {}
        for i in range(0, len(words), WORDS):
            part = words[i : i + WORDS]
            ids = np.array(self.tok.encode_batch_fast([" ".join(texts[i : i + WORDS])], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for w, end in zip(part, ends, strict=True):
                    out[w] = data[4 * at : 4 * end]
                    at = end
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # ASCII capitals are lowered first, as the tokenizer does anyway; not where a special token may be spelled, nor with
        # combining marks (U+0300 to U+036F), which are composed with letters before these are lowered
        whole = lambda t: b"<|" in t or b"\xcc" in t or b"\xcd" in t
        cut = [(t if whole(t) else t.lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        get = self.get
        found = [list(map(get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else () for f in found]
        missing = {c[i] for c, g in zip(cut, gaps, strict=True) for i in g}
        if missing:
            # long pieces are never in self
            long = [m for m in missing if len(m) > LONGEST]
            missing.difference_update(long)
            fresh = self.learn(list(missing)) if missing else {}
            if long:
                told = self.tok.encode_batch_fast([m.decode("utf-8", "replace") for m in long], add_special_tokens=False)
                fresh.update(zip(long, [array("I", e.ids).tobytes() for e in told], strict=True))
            for c, f, g in zip(cut, found, gaps, strict=True):
                for i in g:
                    f[i] = fresh[c[i]]
        return [b"".join(f) for f in found]


class Packer:
    """Packs pieces (doc number, start, length) into sequences: lists of pieces and their tier."""

    def __init__(self) -> None:
        self.tiers: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}
        self.held = 0

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list]]:
        start = 0
        while length - start >= CONTEXT:
            yield CONTEXT, [(doc, start, CONTEXT)]
            start += CONTEXT
        if rest := length - start:
            self.tiers[next(t for t in TIERS if rest <= t)].append((doc, start, rest))
            self.held += rest

    def _best_fit(self, tier: int) -> tuple[list, list]:
        """Full sequences of a tier, and open ones as (room, pieces)."""
        rooms: list[tuple[int, int]] = []
        bins: list[list] = []
        for piece in sorted(self.tiers[tier], key=lambda p: (-p[2], p[0], p[1])):
            i = bisect_left(rooms, (piece[2], -1))
            if i < len(rooms):
                room, b = rooms.pop(i)
            else:
                room, b = tier, len(bins)
                bins.append([])
            bins[b].append(piece)
            if room > piece[2]:
                insort(rooms, (room - piece[2], b))
        opened = {b for _, b in rooms}
        return [x for b, x in enumerate(bins) if b not in opened], [(room, bins[b]) for room, b in rooms]

    def flush(self, last: bool) -> Iterator[tuple[int, list]]:
        """Pack what is held. Open windows are filled by shorter pieces; the last flush leaves nothing."""
        loose: list[tuple[int, int, int]] = []  # pieces of short tiers whose sequences stayed open
        wide: list[tuple[int, list]] = []
        for tier in TIERS:
            full, opened = self._best_fit(tier)
            for x in full:
                yield tier, x
            if tier == CONTEXT:
                wide = opened
            else:
                loose += [p for _, x in opened for p in x]
            self.tiers[tier] = []
        self.held = 0
        order = sorted(((p[2], p[0], p[1]) for p in loose))
        for room, x in sorted(wide, key=lambda w: (w[0], w[1])):
            while room and order:
                i = bisect_left(order, (room + 1,))
                if i:
                    n, doc, start = order.pop(i - 1)
                else:  # none fits: cut the shortest
                    n, doc, start = order.pop(0)
                    insort(order, (n - room, doc, start + room))
                    n = room
                x.append((doc, start, n))
                room -= n
            if room:
                order += [(n, doc, start) for doc, start, n in x]
            else:
                yield CONTEXT, x
        rest = sorted((doc, start, n) for n, doc, start in order)
        if not last:
            for p in rest:
                self.tiers[next(t for t in TIERS if p[2] <= t)].append(p)
                self.held += p[2]
            return
        total, at = sum(n for _, _, n in rest), 0
        while total:
            size = min(CONTEXT, 1 << (total.bit_length() - 1))
            x, room = [], size
            while room:
                doc, start, n = rest[at]
                take = min(n, room)
                x.append((doc, start, take))
                room -= take
                if take < n:
                    rest[at] = (doc, start + take, n - take)
                else:
                    at += 1
            total -= size
            yield size, x


#: What a task writes: SCHEMA, with the task and the number of the sequence among those of its size there.
_PACKED = SCHEMA.replace("step_group long", "task int, number long")


def pack(docs: DataFrame, name: str = TOKENIZER, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA per piece."""
    if name not in PROVEN:
        raise ValueError(f"the cuts of pieces are not proven for {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, task = Ids(tokenizer_path(name)), Packer(), TaskContext.get().partitionId()
        held: dict[int, list] = {}  # by doc number: id, bytes of its ids, tokens not yet given out
        made, numbers, number = 0, {}, 0

        def rows(sequences: Iterator[tuple[int, list]]) -> pa.RecordBatch | None:
            nonlocal made
            out = []
            for tier, parts in sequences:
                place, offset = numbers.get(tier, 0), 0
                numbers[tier] = place + 1
                for doc, start, n in parts:
                    doc_id, data, _ = held[doc]
                    crc = zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)])
                    out.append((doc_id, start, n, crc, len(data) // 4, (task << 32) | made, offset, tier, task, place))
                    offset += n
                    held[doc][2] -= n
                    if not held[doc][2]:
                        del held[doc]
                made += 1
            if not out:
                return None
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            names = [x.split()[0] for x in _PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        mark = end.to_bytes(4, "little")
        for piece in slices(batches, 1, 4 * SLICE_ROWS, SLICE_BYTES // 2):
            for doc_id, data in zip(piece.column(0).to_pylist(), ids.encode(piece.column(1).to_pylist()), strict=True):
                data += mark
                held[number] = [doc_id, data, len(data) // 4]
                if b := rows(packer.add(number, len(data) // 4)):
                    yield b
                number += 1
            if packer.held > POOL and (b := rows(packer.flush(False))):
                yield b
        if b := rows(packer.flush(True)):
            yield b

    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("data"))
    packed = materialise(d.mapInArrow(run, _PACKED), "packed")
    made = packed.groupBy("tier", "task").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    made = materialise(made.select("tier", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "packed-counts")
    step = F.floor((F.col("before") + F.col("number")) / F.greatest(F.lit(1), F.floor(F.lit(STEP) / F.col("tier"))))
    return packed.join(made, ["tier", "task"]).select(*[x.split()[0] for x in SCHEMA.split(", ")[:-1]], step.cast("long").alias("step_group"))
