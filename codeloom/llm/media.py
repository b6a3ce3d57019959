"""Media columns: texts or other bytes kept as 8-bit WAV, and spectral landmarks read back from them.

``encode_wav`` stores every payload without loss in a WAV container written by the ``wave`` module.
``spectral_landmarks`` opens the stored bytes again, takes a short-time Fourier transform, keeps the
strongest bin of each frame and pairs it with the peaks of the next frames.  Each pair is one long:
frame number, both bins and their distance in frames, so the array is ordered by time.

Defined results: a null text is an empty one; an empty payload is one block of 64 zero bytes; equal
texts give equal values; repeated rows are kept; an empty table gives an empty result with the same
columns; columns of the input that bear an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces, with_last, without

BLOCK = 64
FRAME, HOP, FAN_OUT, RATE = 256, 128, 3, 8000
_WINDOW = np.hanning(FRAME).astype(np.float32)
_FRAMES_AT_ONCE = 4096


def to_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def frames_of(payload: bytes) -> np.ndarray:
    """Overlapping frames of the samples; silence fills the last one, so that every sample is in a frame."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    missing = FRAME - len(samples) if len(samples) < FRAME else (FRAME - len(samples)) % HOP
    return np.lib.stride_tricks.sliding_window_view(np.pad(samples, (0, missing)), FRAME)[::HOP]


def landmarks(payload: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks: frame << 32 | bin << 20 | later bin << 8 | frames between."""
    frames = frames_of(payload)
    peaks = np.empty(len(frames), np.int64)
    for at in range(0, len(frames), _FRAMES_AT_ONCE):
        block = frames[at : at + _FRAMES_AT_ONCE]
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)[:, 1:]
        power = spectrum.real**2 + spectrum.imag**2
        peaks[at : at + _FRAMES_AT_ONCE] = power.argmax(axis=1) + 1
    time = np.arange(len(peaks), dtype=np.int64)
    pairs = [time[: len(peaks) - d] << 32 | peaks[: len(peaks) - d] << 20 | peaks[d:] << 8 | d for d in range(1, min(FAN_OUT, len(peaks) - 1) + 1)]
    return np.sort(np.concatenate(pairs)) if pairs else peaks << 20


def encode_wav(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Replaces the text column by ``n_bytes`` and the WAV bytes of the padded payload."""
    kept = without(docs, media_col, "n_bytes", text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])
    names = kept.columns

    def run(batches):
        for batch in pieces(batches, len(names)):
            sizes, media = [], []
            for text in batch.column(len(names)).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(to_wav(raw + bytes(-len(raw) % BLOCK if raw else BLOCK)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*names, "n_bytes", media_col])

    return with_last(docs, text_col, media_col, "n_bytes").mapInArrow(run, schema)


_FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("landmarks", T.ArrayType(T.LongType())),
        T.StructField("feature", T.StringType()),
    ]
)


def spectral_landmarks(media: DataFrame, media_col: str = "media", with_landmarks: bool = True) -> DataFrame:
    """Reads the stored WAV bytes back and replaces them by checksums, landmarks and their digest."""
    added = [f for f in _FEATURES.fields if with_landmarks or f.name != "landmarks"]
    kept = without(media, media_col, *[f.name for f in _FEATURES.fields])
    names, schema = kept.columns, T.StructType([*kept.schema.fields, *added])
    types = {"landmarks": pa.list_(pa.int64())} | {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in added if f.name != "landmarks"}

    def run(batches):
        for batch in pieces(batches, len(names)):
            rows = []
            for stored in batch.column(len(names)):
                stored = stored.as_py()
                payload = from_wav(stored)
                marks = landmarks(payload)
                rows.append(
                    {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
                        "media_bytes": len(stored),
                        "media_sha256": hashlib.sha256(stored).hexdigest(),
                        "landmarks": marks,
                        "feature": f"{len(marks)}:{hashlib.sha256(marks.astype('<i8').tobytes()).hexdigest()}",
                    }
                )
            arrays = [pa.array([r[f.name] for r in rows], types[f.name]) for f in added]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*names, *[f.name for f in added]])

    return with_last(media, media_col, *[f.name for f in _FEATURES.fields]).mapInArrow(run, schema)
