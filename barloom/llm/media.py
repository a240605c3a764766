"""Media columns: audio bytes as WAV, and spectral-peak pair fingerprints.

Samples are written into WAV bytes by the `wave` module and stored as a binary column of a table. The stored
bytes are read back by the same module; a short-time Fourier transform gives frames, the strongest bin of
each frame in each band is a peak if no nearby frame has a stronger one there, and peaks are paired with the
next few. A fingerprint is the pair (time of the first peak, code of both frequencies and their distance in
time), stored as one long: time in the upper 32 bits, code in the lower.

Edge cases: a null or empty text is a payload of 64 zero bytes; payloads of silence have no peaks; equal
texts give equal bytes and features; of equally strong bins the lowest is the peak, of equally strong neighbouring
frames the earlier one; very long payloads are transformed in blocks of frames; repeated rows
are returned as often as they come; an empty table gives no rows; columns that the frame has under the names of
those made here (n_bytes, media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, landmarks) are
replaced, all others stay.
"""
from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barloom.llm.common import saved, table, utf8
from barloom.llm.registry import query

RATE = 8000
FRAME, HOP = 256, 128
BANDS = ((1, 8), (8, 20), (20, 48), (48, 128))  # bins of the transform, above the constant one
NEAR = 2  # frames on either side that must not have a stronger peak in the band
FAN_OUT = 3
BLOCK = 4096  # frames transformed at a time
WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Mono WAV of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are expected")
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band the strongest bin and its magnitude."""
    x = np.frombuffer(samples, np.uint8)
    over = (len(x) - FRAME) % HOP if len(x) > FRAME else len(x) - FRAME
    if over:  # the last frame is filled up with silence
        x = np.pad(x, (0, HOP - over if over > 0 else -over), constant_values=128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, sizes = [], []
    for start in range(0, len(frames), BLOCK):
        part = (frames[start:start + BLOCK].astype(np.float32) - 128) * WINDOW
        spectrum = np.abs(np.fft.rfft(part, axis=1).astype(np.complex64))
        best = [lo + spectrum[:, lo:hi].argmax(1) for lo, hi in BANDS]
        bins.append(np.stack(best, 1))
        sizes.append(np.take_along_axis(spectrum, bins[-1], 1))
    return np.concatenate(bins), np.concatenate(sizes)


def landmarks(samples: bytes) -> np.ndarray:
    """Time-coded fingerprints of a payload, in the order of time."""
    bins, sizes = band_peaks(samples)
    top = sizes > 1e-3
    for d in range(1, NEAR + 1):  # of equal neighbours the earlier one counts
        top[:-d] &= sizes[:-d] >= sizes[d:]
        top[d:] &= sizes[d:] > sizes[:-d]
    t, band = np.nonzero(top)
    f = bins[t, band].astype(np.int64)
    t = t.astype(np.int64)
    out = []
    for d in range(1, FAN_OUT + 1):
        gap = np.minimum(t[d:] - t[:-d], 0xFFFF)
        out.append(t[:-d] << 32 | f[:-d] << 24 | f[d:] << 16 | gap)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def with_wav(docs: DataFrame, text: str = "text", multiple: int = 64) -> DataFrame:
    """The frame with `n_bytes` and `media`: the text's UTF-8 bytes, padded with zeros, as WAV."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for t in batch.columns[-1].to_pylist():
                data = utf8(t)
                sizes.append(len(data))
                media.append(to_wav(data + bytes(-len(data) % multiple if data else multiple)))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                names=[*rest, "n_bytes", "media"])

    rest = [c for c in docs.columns if c not in (text, "n_bytes", "media")]
    kept = docs.select(*rest)
    schema = kept.schema.add("n_bytes", "long").add("media", "binary")
    # the text travels under a name longer than all others, which is therefore free
    return docs.select(*rest, F.col(text).alias(max(rest, key=len, default="") + "_")).mapInArrow(run, schema)


def with_landmarks(stored: DataFrame, media: str = "media") -> DataFrame:
    """From a stored media column: its size and digest, the payload's size, digest and tail CRC, and the
    fingerprints."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.columns[-1].to_pylist():
                p = from_wav(m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), landmarks(p)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[*rest, *names])

    rest = [c for c in stored.columns if c not in (media, *names)]
    schema = stored.select(*rest).schema
    for n, kind in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.LongType()))):
        schema = schema.add(n, kind)
    return stored.select(*rest, F.col(media).alias(max(rest, key=len, default="") + "_")).mapInArrow(run, schema)


@query("op7_media")
def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the number of fingerprints and a digest of them; the time-coded array itself follows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = saved(with_wav(docs), "media")
    feature = F.concat_ws(":", F.size("landmarks").cast("string"), F.md5(F.array_join("landmarks", ",").cast("binary")))
    return with_landmarks(stored).withColumn("feature", feature)
