"""Media columns: texts stored as WAV, read back, and described by spectral-peak pairs.

The payload is the text as UTF-8, filled with zero bytes to a positive multiple of 64, held as 8-bit mono samples in a WAV
file that the wave module writes and reads. Of the samples read back, short-time Fourier transforms (Hann windows of FRAME
samples without zero ends, HOP apart, a rest at the end level with the silence that fills its frame: every sample is in one) give the strongest peak of each frame in BANDS bands; each frame's strongest peaks are paired with those
of the next FAN frames. A pair is one code (band bin, later bin, frames between) at its frame: arrays ``frames`` and ``codes``.
The last frame has no later one: its own peaks are paired, zero frames between.

Each document is one row of one task, so nothing is shuffled. Frames are transformed CHUNK at a time: memory is bounded by
the text itself and one chunk.

Cases: a null text is empty and stores 64 zero bytes; null ids stay null; repeated rows give equal values; ties between bins
go to the lower one; an empty table gives an empty result; other columns are not carried along.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import slices, text_of

UNIT, RATE = 64, 8000
FRAME, HOP, CHUNK, FAN, PEAKS = 256, 128, 4096, 3, 2
#: Edges of the bands in bins of the transform.
BANDS = (1, 9, 33, 129)

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, frames array<int>, codes array<long>"
)


def encode(data: bytes) -> bytes:
    """The WAV file of a payload: data with zero bytes up to a positive multiple of UNIT."""
    payload = data + b"\0" * (-len(data) % UNIT or (0 if data else UNIT))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """Bins of the strongest peak of each band, one row per frame, strongest band first."""
    x = samples.astype(np.float32) - 128.0
    # a short text has a window of its own length, whose ends hide the step to the silence after it
    size = min(FRAME, len(x))
    window = np.pad(np.hanning(size + 2)[1:-1], (0, FRAME - size)).astype(np.float32)
    x = np.pad(x, (0, FRAME - size))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)
    frames = frames[::HOP]
    if (len(x) - FRAME) % HOP:
        rest = x[len(frames) * HOP :]
        # without its mean there is no step to the silence
        frames = np.concatenate([frames, np.pad(rest - rest.mean(), (0, FRAME - len(rest)))[None]])
    n = len(frames)
    out = np.empty((n, len(BANDS) - 1), np.int64)
    for i in range(0, n, CHUNK):
        power = np.abs(np.fft.rfft(frames[i : i + CHUNK] * window, axis=1)).round(3)
        bins, height = [], []
        for a, b in zip(BANDS, BANDS[1:], strict=False):
            part = power[:, a:b]
            k = part.argmax(axis=1)
            bins.append(k + a)
            height.append(part[np.arange(len(k)), k])
        order = np.argsort(-np.stack(height, axis=1), axis=1, kind="stable")
        out[i : i + CHUNK] = np.take_along_axis(np.stack(bins, axis=1), order, axis=1)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of the pairs of a frame's strongest peaks with the strongest of the next FAN frames.

    The last frame's pairs are those among its own peaks.
    """
    own = [(int(a) << 20) | (int(b) << 8) for i, a in enumerate(found[-1]) for b in found[-1, i + 1 :]]
    at, codes = [np.full(len(own), len(found) - 1)], [np.array(own, np.int64)]
    for step in range(1, FAN + 1):
        later = found[step:, 0]
        for p in range(PEAKS):
            first = found[: len(found) - step, p] if len(found) > step else found[:0, p]
            codes.append((first << 20) | (later << 8) | step)
            at.append(np.arange(len(first)))
    at_all, codes_all = np.concatenate(at), np.concatenate(codes)
    order = np.lexsort((codes_all, at_all))
    return at_all[order].astype(np.int32), codes_all[order]


def describe(data: bytes) -> tuple:
    """The columns of SCHEMA after doc_id."""
    stored = encode(data)
    payload = decode(stored)
    at, codes = pairs(peaks(np.frombuffer(payload, np.uint8)))
    feature = hashlib.sha256(at.astype("<i4").tobytes() + codes.astype("<i8").tobytes()).hexdigest()
    return (
        len(data),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-UNIT:]),
        len(stored),
        hashlib.sha256(stored).hexdigest(),
        f"{len(codes)}:{feature}",
        at,
        codes,
    )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, 1):
        rows = [describe(x) for x in piece.column(1).to_pylist()]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "codes")
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), *columns], names=["doc_id", *names])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA per document."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("data"))
    return d.mapInArrow(_described, SCHEMA)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, 1):
        wavs = [encode(x) for x in piece.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(wavs, pa.binary())], names=["doc_id", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media, the WAV file of each document."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("data"))
    return d.mapInArrow(_stored, "doc_id long, media binary")
