"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are the majority of the hashes of its 4-word shingles. Two fingerprints that differ in at most four
bits differ in at most one bit of one of three segments, so each is indexed under its 64 one-wildcard variants: its segment
with one bit left out. Equal variants meet by an equality shuffle; each pair is verified once, under its first common
variant, and of the links within one variant a spanning forest is kept: no link between components is lost, and the rows
written stay in proportion to the fingerprints.

Scale: copies of a fingerprint are one row before the index is made. A variant with more than 2 * BLOCK fingerprints (known
from the counts of exact segments) is dealt out as pairs of blocks, so no task holds more than about two blocks of it and
all its pairs are still compared. Fingerprints find their component, and documents their fingerprint, by look_up: a fingerprint
of a third of all documents, or a component of a third of all fingerprints, is not gathered in one task.

Cases: null and texts without words have fingerprint zero, linked like any other; shorter texts than four words are one
shingle; null ids get a component (the smallest id that is not null, else null); repeated rows have one row each; an empty
table gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import look_up, materialise, slices, text_of
from strata.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bits of the three segments, and the end.
SEGMENTS = (0, 21, 42, 64)
BLOCK, FEW = 2048, 48


def hashes(text: bytes) -> list[int]:
    """XXH64 of the shingles of lower-cased words."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def majority(hashed: list[int]) -> int:
    """The fingerprint of a text's shingle hashes: bits set in over half of them."""
    if not hashed:
        return 0
    total = np.zeros(64, np.int64)
    rows = np.array(hashed, np.uint64)
    for i in range(0, len(rows), 1 << 14):
        part = rows[i : i + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(rows), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, 1):
        found = np.array([majority(hashes(t)) for t in piece.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("t"))
    return d.mapInArrow(_fingerprints, "doc_id long, fp long")


def _variants(fp: Column) -> Column:
    """The 64 variants of a fingerprint: left-out bit and the rest of its segment in one int."""
    out = []
    for a, b in zip(SEGMENTS, SEGMENTS[1:], strict=False):
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        for bit in range(a, b):
            rest = part.bitwiseAND(F.lit(((1 << (b - a)) - 1) ^ (1 << (bit - a))))
            out.append(rest.bitwiseOR(F.lit(bit << 22)).cast("int"))
    return F.array(*out)


def first_variant(x: np.ndarray) -> np.ndarray:
    """For differences x of fingerprints: the left-out bit of the first variant both have, -1 if there is none."""
    out = np.full(len(x), -1, np.int64)
    for a, b in reversed(list(zip(SEGMENTS, SEGMENTS[1:], strict=False))):
        part = (x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        n = np.bitwise_count(part)
        out[n == 0] = a
        one = n == 1
        out[one] = a + np.bitwise_count(part[one] - np.uint64(1))
    return out


def _near(f: np.ndarray, g: np.ndarray, bit: np.ndarray | int) -> np.ndarray:
    x = f ^ g
    ok = np.flatnonzero((np.bitwise_count(x) <= DISTANCE) & (x != 0))
    bits = bit[ok] if isinstance(bit, np.ndarray) else bit
    return ok[first_variant(x[ok]) == bits]


def forest(f: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of f near each other under this variant join: one star per component."""
    label = np.arange(len(f))
    left, right = [], []
    for i in range(0, len(f), 512):
        for j in range(i, len(f), 512):
            p, q = f[i : i + 512], f[j : j + 512]
            near = _near(np.repeat(p, len(q)), np.tile(q, len(p)), bit)
            left.append(i + near // len(q))
            right.append(j + near % len(q))
    a, b = np.concatenate(left), np.concatenate(right)
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            break
    star = np.flatnonzero(label != np.arange(len(f)))
    return f[label[star]], f[star]


def _links_of(key: np.ndarray, group: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of sorted rows: equal (key, group)."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
    size = np.diff(np.append(new, len(key)))
    number = np.repeat(np.arange(len(new)), size)
    bit = key.astype(np.int64) >> 22
    left, right = [f[:0]], [f[:0]]
    few = np.repeat(size <= FEW, size)
    for step in range(1, min(FEW, int(size.max(initial=1)))):
        i = np.flatnonzero((number[step:] == number[:-step]) & few[step:])
        if not len(i):
            break
        near = i[_near(f[i], f[i + step], bit[i])]
        left.append(f[near])
        right.append(f[near + step])
    for k in np.flatnonzero(size > FEW):
        a, b = forest(np.unique(f[new[k] : new[k] + size[k]]), int(bit[new[k]]))
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, part, fp) sorted by key and part; a group may span batches."""
    held: list[np.ndarray] | None = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _links_of(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        rows[2] = rows[2].view(np.uint64)
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield links([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None and len(held[0]):
        yield links(held)


def _hot(distinct: DataFrame, block: int) -> DataFrame:
    """(key, parts) of variants that may hold more than 2 * block fingerprints: parts blocks of about block each.

    A variant holds two exact segments, so one of them has over block fingerprints.
    """
    fp = F.col("fp")
    segments = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v"))
            for a, b in zip(SEGMENTS, SEGMENTS[1:], strict=False)
        ]
    )
    many = distinct.select(F.explode(segments).alias("x")).groupBy("x.a", "x.v").agg(F.count("*").alias("n"))
    many = many.filter(F.col("n") > block).withColumn("fp", F.expr("shiftleft(v, a)"))
    keys = many.select("a", "n", F.posexplode(_variants(F.col("fp"))).alias("bit", "key"))
    last = F.lit(64)
    for a, b in zip(SEGMENTS[:-1], SEGMENTS[1:], strict=True):
        last = F.when(F.col("a") == a, F.lit(b)).otherwise(last)
    keys = keys.filter((F.col("bit") >= F.col("a")) & (F.col("bit") < last))
    parts = F.ceil((F.sum("n") + block) / block).cast("int")
    return materialise(keys.groupBy("key").agg(parts.alias("parts")), "simhash-hot")


def link_table(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) at most DISTANCE bits apart."""
    index = distinct.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    hot = _hot(distinct, block)
    if not hot.isEmpty():
        dealt = index.join(hot, "key", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        part = F.coalesce(F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other"), F.lit(0))
        dealt = dealt.select("*", F.explode(others).alias("other")).select("key", part.cast("int").alias("part"), "fp")
        index = dealt.repartition("key", "part")
    else:
        index = index.select("key", F.lit(0).alias("part"), "fp").repartition("key")
    return index.sortWithinPartitions("key", "part").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = materialise(first, "simhash-distinct")
    roots = components(link_table(first.select("fp"), block))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "simhash-components")
    named = materialise(look_up(rooted.select("fp", "root", F.col("n").alias("docs")), ids, "root").select("fp", "component_id", F.col("docs").alias("n")), "simhash-named")
    return look_up(found, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of docs for each component: that of its smallest id, with the columns of docs.

    Rows that go are found in narrow tables; texts are shuffled only for ids that stay and are there more than once.
    Rows with a null id stay as they are, since no id tells them apart.
    """
    near = materialise(near_duplicates(docs, block=block).select("doc_id", "component_id"), "simhash-groups")
    gone = near.filter("doc_id <> component_id").select("doc_id").distinct()
    stays = docs.join(materialise(gone, "simhash-gone"), "doc_id", "left_anti").select(docs.columns)
    again = near.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialise(again, "simhash-again")
    if again.isEmpty():
        return stays
    others = [c for c in docs.columns if c != "doc_id"]
    one = stays.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("r"))
    one = one.select("doc_id", "r.*").select(docs.columns)
    return stays.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one)
