"""Toxicity by compression distance: windows are compressed with toxic and with ordinary zstandard dictionaries.

Training texts come from a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_ORDINARY labels, by hash of the id). Two
thirds of them, by hash of the text so that copies stay together, train the dictionaries; the rest, which no dictionary has
seen, calibrates the thresholds.

Most windows of a toxic text are ordinary. The toxic dictionaries are therefore trained on its telling windows: those that
hold a string of one of the lengths STRINGS which is in at least MIN_TEXTS toxic texts and MIN_LIFT times as often in toxic as
in ordinary windows (windows with the same neighbours, as copies have, count once). PAIRS pairs of dictionaries are trained by zstandard, the toxic
one of a pair on three quarters of these windows, the ordinary one on as many ordinary windows; all of them stand behind one
base trained on all ordinary windows, which serves what both kinds of text share. A window's distance is how many bytes less
it takes with the toxic than with the ordinary dictionaries, summed over the pairs; pairs after one where the sum is not above
zero are spared. A mark in front of the window that every
dictionary ends with, and bytes behind it in which no match may begin, make the lengths comparable byte by byte.

A logistic model over counts and shares of windows with at least each of THRESHOLDS bytes of distance is fitted on the unseen
third; its cut is where the missed share plus FALSE_COST times the falsely named share is least there.

Every whole text is cut into windows of at least WINDOW bytes at word ends; nothing is shuffled; the model has under 1 MB.

Cases: a null or empty text has no windows and gets the score of a text without toxic windows; a null id counts as '' and is
held out; repeated rows get equal scores, and of repeated ids the least text is sampled; ties in hashes are ordered by id; a
very long text is scored whole; without toxic or without ordinary labels, or without a telling string, every score is the
share of toxic labels, 0.49 at most; an empty table gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, text_of

SAMPLE_TOXIC, SAMPLE_ORDINARY, SEED = 1000, 2000, 5
WINDOW, LEVEL, PAIRS = 6, 3, 5
BASE_BYTES, TAIL_BYTES, ROUND_BYTES = 131072, 4096, 1024
STRINGS, MIN_TEXTS, MIN_LIFT = (6, 8), 4, 10.0
THRESHOLDS = (1, 2, 4, 6, 8, 10, 12, 16, 20)
FALSE_COST = 2.0
MEMO = 300_000
#: Bytes in front of a window, the end of each dictionary, and bytes behind it: the compressor begins no match in the last 8.
_MARK, _REST = bytes(range(1, 9)) + bytes(range(14, 32)), bytes(range(14, 22)) + b"\x0e"


def windows(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, joined to windows of WINDOW bytes or a little more, with a space at both ends."""
    out, held, size = [], [], 0
    for word in text.lower().split():
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(held))
            held, size = [], 0
    if held:
        out.append(b" %b " % b" ".join(held))
    return out


@dataclass
class Model:
    base: bytes = b""
    #: Pairs of ordinary and toxic dictionaries.
    pairs: list[tuple[bytes, bytes]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    rate: float = 0.0


class Scorer:
    """Compressors of a model. Distances of repeated windows are remembered, MEMO at most."""

    def __init__(self, model: Model):
        self.model = model
        self.compress = [tuple(_compressor(model.base + x + _MARK).compress for x in pair) for pair in model.pairs]
        self.memo: dict[bytes, int] = {}

    def distance(self, window: bytes) -> int:
        found = self.memo.get(window)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            text = _MARK + window + _REST
            found = 0
            for ordinary, toxic in self.compress:
                found += len(ordinary(text)) - len(toxic(text))
                if found <= 0:
                    break
            self.memo[window] = found
        return found

    def features(self, text: bytes) -> list[float]:
        found = windows(text)
        d = Counter(map(self.distance, found))
        at_least = [sum(n for k, n in d.items() if k >= t) for t in THRESHOLDS]
        share = 50 / (len(found) + 25)
        return [math.log1p(n) for n in at_least] + [math.log1p(n * share) for n in at_least]

    def score(self, text: bytes) -> float:
        if not self.model.weights:
            return self.model.rate
        z = self.model.bias + sum(w * x for w, x in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)


def _trained(size: int, samples: list[bytes], k: int, d: int = 8) -> bytes:
    """A dictionary trained on samples; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL, dict_id=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _trained_in_rounds(size: int, samples: list[bytes], told: set[bytes]) -> bytes:
    """A dictionary trained on samples, then on those with a telling string that is not in it yet, up to size bytes.

    The trainer ends early where samples repeat, which telling windows do.
    """
    out = b""
    while samples and size - len(out) >= 256:
        out = _trained(min(size - len(out), ROUND_BYTES), samples, 10) + out
        left = [w for w in samples if not all(s in out for n in STRINGS for s in _strings(w, n) & told)]
        if len(left) == len(samples):
            break
        samples = left
    return out


def _strings(window: bytes, n: int) -> set[bytes]:
    return {window[i : i + n] for i in range(len(window) - n + 1)}


def _contexts(texts: Sequence[list[bytes]]) -> list[list[bytes]]:
    """Of each text the windows that stand between neighbours which they did not have before: copies count once."""
    seen: set[tuple[bytes, bytes, bytes]] = set()
    out = []
    for t in texts:
        new = [x for x in zip([b"", *t], t, [*t[1:], b""], strict=False) if x not in seen]
        seen.update(new)
        out.append([w for _, w, _ in new])
    return out


def telling_strings(toxic: Sequence[list[bytes]], ordinary: Sequence[list[bytes]]) -> set[bytes]:
    """Strings that tell toxic from ordinary texts, each a list of windows."""
    own, other = _contexts(toxic), Counter(w for t in _contexts(ordinary) for w in t)
    windows_of = Counter(w for t in own for w in t)
    scale = (other.total() + 1) / (windows_of.total() + 1)
    out = set()
    for n in STRINGS:
        texts = Counter(s for t in own for s in set().union(*(_strings(w, n) for w in t)))
        bad, good = Counter(), Counter()
        for w, k in windows_of.items():
            for s in _strings(w, n):
                if texts[s] >= MIN_TEXTS:
                    bad[s] += k
        for w, k in other.items():
            for s in _strings(w, n):
                if s in bad:
                    good[s] += k
        out |= {s for s, k in bad.items() if (k + 0.5) * scale >= MIN_LIFT * (good[s] + 0.5)}
    return out


def dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> Model | None:
    """Base and pairs of dictionaries; none without a telling string."""
    bad, good = [windows(t) for t in toxic], [windows(t) for t in ordinary]
    told = telling_strings(bad, good)
    chosen = [w for t in bad for w in dict.fromkeys(t) if any(_strings(w, n) & told for n in STRINGS)]
    common = [w for t in good for w in t]
    if not chosen or not common:
        return None
    r = random.Random(SEED)
    distinct = list(dict.fromkeys(common))
    r.shuffle(distinct)
    model = Model(_trained(BASE_BYTES, [b"".join(distinct[i : i + 4]) for i in range(0, len(distinct), 4)], 32))
    for _ in range(PAIRS):
        n = -(-3 * len(chosen) // 4)
        x = _trained_in_rounds(TAIL_BYTES, r.sample(chosen, n), told)
        y = _trained(max(256, len(x)), r.choices(common, k=n), 10)
        size = max(len(x), len(y))
        model.pairs.append((y.rjust(size), x.rjust(size)))
    return model


def fit(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> Model:
    """Dictionaries, logistic weights and cut, from labelled texts."""
    rate = min(len(toxic) / max(1, len(toxic) + len(ordinary)), 0.49)
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    unseen = lambda t: xxhash.xxh64_intdigest(t, SEED) % 3 == 0
    model = dictionaries([t for t in toxic if not unseen(t)], [t for t in ordinary if not unseen(t)])
    rows = [(t, y) for y, texts in ((1.0, toxic), (0.0, ordinary)) for t in texts if unseen(t)]
    y = np.array([label for _, label in rows])
    if model is None or not 0 < y.sum() < len(y):
        return Model(rate=rate)
    scorer = Scorer(model)
    a = np.c_[np.array([scorer.features(t) for t, _ in rows]), np.ones(len(rows))]
    w, ridge = np.zeros(a.shape[1]), np.r_[np.ones(a.shape[1] - 1), 1e-6]
    for _ in range(50):  # Newton steps, ridge of one
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        w = w - np.linalg.solve(h, a.T @ (p - y) + ridge * w)
    z = a @ w
    steps = np.unique(z)
    cuts = np.r_[(steps[1:] + steps[:-1]) / 2, steps[-1] + 1]
    cost = [np.mean(z[y == 1] < c) + FALSE_COST * np.mean(z[y == 0] >= c) for c in cuts]
    model.weights, model.bias = w[:-1].tolist(), float(w[-1] - cuts[int(np.argmin(cost))])
    return model


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_ordinary: int = SAMPLE_ORDINARY) -> DataFrame:
    """Labelled texts not held out: t, toxic. At most n_toxic and n_ordinary labels, by hash of the id."""
    known = labels.filter(~held_out(labels) & labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull())
    known = known.select("doc_id", "toxic", F.xxhash64(F.lit(SEED), "doc_id").alias("h")).distinct()
    chosen = known.filter("toxic = 1").orderBy("h", "doc_id").limit(n_toxic)
    chosen = chosen.unionByName(known.filter("toxic = 0").orderBy("h", "doc_id").limit(n_ordinary)).select("doc_id", "toxic")
    texts = docs.select("doc_id", text_of(docs).cast("binary").alias("t")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model of the sample, which is collected: its size is a parameter."""
    rows = [(bytes(r["t"]), r["toxic"]) for r in sample(docs, labels, **options).select("t", "toxic").collect()]
    return fit([t for t, y in rows if y == 1], [t for t, y in rows if y == 0])


def score_documents(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = model or train(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for piece in slices(batches, 2):
            scores = [scorer.score(t) for t in piece.column(2).to_pylist()]
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), piece.column(1), pa.array(scores, pa.float64()), predicted],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    d = docs.select(docs["doc_id"].cast("long"), held_out(docs).alias("held_out"), text_of(docs).cast("binary").alias("t"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
