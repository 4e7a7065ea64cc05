"""Media columns: payloads kept as WAV, short-time Fourier transforms, spectral-peak pair fingerprints.

A payload becomes 8-bit mono samples in a WAV file, written and read by the ``wave`` module; the round trip is exact. From
the samples read back come short-time Fourier magnitudes (Hann window of 256 samples, hop 128), their peaks (a bin above
its eight neighbours in time and frequency and above the frame's mean magnitude, the strongest per frame band), and pairs of a peak with the next ones within a
target zone. A pair is stored as one 64-bit integer: frame << 32 | f1 << 20 | f2 << 8 | frames between.

Defined cases: a null text is empty; an empty text gives 64 zero bytes; equal texts give equal values in every column, since each text is transformed by itself in
blocks of a fixed number of frames; long texts are transformed block by block, so memory follows the block and not the text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit

RATE, WINDOW, HOP, BLOCK = 8000, 256, 128, 512
BANDS = (1, 16, 40, 72, 128)
FAN_OUT, ZONE = 3, 8
_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if r.getsampwidth() != 1 or r.getnchannels() != 1:
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def stft(samples: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Magnitudes of the frames begin..end; frames past the samples are padded by silence."""
    piece = samples[begin * HOP : (end - 1) * HOP + WINDOW].astype(np.float32) - 128
    short = (end - begin - 1) * HOP + WINDOW - len(piece)
    if short > 0:
        piece = np.concatenate([piece, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(piece, WINDOW)[::HOP]
    return np.abs(np.fft.rfft(frames * _HANN, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(frame, bin) of the spectral peaks in order, and the number of frames."""
    n = max(1, -(-(len(samples) - WINDOW) // HOP) + 1)
    times, bins = [], []
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        lo, hi = max(0, a - 1), min(n, b + 1)
        m = stft(samples, lo, hi)
        pad = np.pad(m, 1, constant_values=-1)
        rows, cols = m.shape
        top = np.maximum(np.maximum(pad[:-2], pad[2:]), pad[1:-1])  # over time
        around = np.maximum(np.maximum(top[:, :-2], top[:, 2:]), np.maximum(pad[:-2, 1:-1], pad[2:, 1:-1]))
        is_peak = (m > around) & (m > m.mean(1, keepdims=True))
        is_peak = is_peak[a - lo : a - lo + b - a]
        m = m[a - lo : a - lo + b - a]
        for low, high in zip(BANDS, BANDS[1:], strict=False):
            band = np.where(is_peak[:, low:high], m[:, low:high], -1)
            best = band.argmax(1)
            at = np.flatnonzero(band[np.arange(len(band)), best] >= 0)
            times.append(at + a)
            bins.append(best[at] + low)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order], n


def pairs(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Time-coded pairs of each peak with up to FAN_OUT later ones within ZONE frames."""
    out = []
    after = np.searchsorted(t, t, "right")  # the first peak of a later frame
    for j in range(FAN_OUT):
        at = np.flatnonzero(after + j < len(t))
        to = after[at] + j
        gap = t[to] - t[at]
        near = gap <= ZONE
        at, to, gap = at[near], to[near], gap[near]
        out.append(t[at].astype(np.int64) << 32 | f[at].astype(np.int64) << 20 | f[to].astype(np.int64) << 8 | gap.astype(np.int64))
    return np.sort(np.concatenate(out))


def features(payload: bytes) -> tuple[int, int, np.ndarray]:
    t, f, n = peaks(np.frombuffer(payload, np.uint8))
    return n, len(t), pairs(t, f)


_MEDIA = "media binary, n_bytes long"
_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_peaks long, fingerprint array<long>"


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the text but with its WAV column ``media`` and ``n_bytes``, the unpadded length."""
    keep = [c for c in docs.columns if c not in (text, "media", "n_bytes")]
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in textkit.slices(batch, text):
                media = [encode(payload_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(media, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "media", "n_bytes"])

    from pyspark.sql.types import StructType

    return docs.mapInArrow(run, StructType([*fields, *StructType.fromDDL(_MEDIA).fields]))


def fingerprint(media: DataFrame, column: str = "media") -> DataFrame:
    """Reads the stored bytes back; the media column gives way to digests and fingerprints."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(_FEATURES)
    keep = [c for c in media.columns if c != column and c not in new.names]
    fields = [media.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for m in part.column(column).to_pylist():
                    p = decode(m)
                    n, k, codes = features(p)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), n, k, codes))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*keep, *new.names])

    return media.mapInArrow(run, StructType([*fields, *new.fields]))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fingerprint(to_media(docs))
    digest = F.sha2(F.concat_ws(",", F.col("fingerprint").cast("array<string>")), 256)
    feature = F.concat_ws(":", "n_frames", "n_peaks", F.size("fingerprint"), F.substring(digest, 1, 32))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
