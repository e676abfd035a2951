"""Media columns: texts stored as WAV audio, read back, and described by fingerprints of their spectrum."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_batch, slim, store, table, utf8

#: Samples from one frame of the short-time Fourier transform to the next; a frame has twice as many.
HOP = 192
RATE = 8000
#: Frequency bins at which the bands begin and end in which peaks are sought.
BANDS = (1, 12, 28, 60, HOP + 1)
#: Each peak is paired with so many that follow it.
FAN = 3
BLOCK = 1024


def wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def unwav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())[: w.getnframes()]  # without the byte that pads odd files


_window = np.hanning(2 * HOP).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and bins of the spectral peaks: in each band of a frame the strongest bin, where it is stronger than the
    strongest of the band in the frame before and no weaker than in the one after. Works in blocks of frames."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x) // HOP
    bins, heights = np.empty((len(BANDS) - 1, n), np.int32), np.empty((len(BANDS) - 1, n), np.float32)
    for at in range(0, n, BLOCK):
        part = x[at * HOP : (min(n, at + BLOCK) + 1) * HOP].astype(np.float32) - 128
        part = np.append(part, np.zeros((min(n, at + BLOCK) + 1 - at) * HOP - len(part), np.float32))
        frames = np.lib.stride_tricks.sliding_window_view(part, 2 * HOP)[::HOP] * _window
        spectrum = np.fft.rfft(frames, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            best = power[:, low:high].argmax(axis=1)
            bins[k, at : at + len(frames)] = best + low
            heights[k, at : at + len(frames)] = power[np.arange(len(frames)), best + low]
    edge = np.full((len(BANDS) - 1, 1), -1, np.float32)
    high = (heights > np.hstack([edge, heights[:, :-1]])) & (heights >= np.hstack([heights[:, 1:], edge])) & (heights > 0)
    frame, band = np.nonzero(high.T)
    return frame.astype(np.int32), bins[band, frame]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frames of the anchors) and hashes (anchor's bin, partner's bin, frames between) of pairs of peaks."""
    frame, bin_ = peaks(samples)
    times, codes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for k in range(1, min(FAN, len(frame) - 1) + 1):
        gap = np.minimum(frame[k:] - frame[:-k], 255).astype(np.int64)
        times.append(frame[:-k])
        codes.append((bin_[:-k].astype(np.int64) << 16 | bin_[k:]) << 8 | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


FIELDS = [
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pairs", pa.int64()),
]
ARRAYS = [("media", pa.binary()), ("pair_time", pa.list_(pa.int32())), ("pair_hash", pa.list_(pa.int64()))]
DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pairs bigint"


def media_columns(docs: DataFrame, arrays: bool = True) -> DataFrame:
    """docs (doc_id, text) as audio: the text's bytes, with spaces appended up to a positive multiple of 192, are the samples
    of a WAV file; everything but n_bytes is computed from what is read back from that file.

    With arrays, the rows also carry the file (media) and the fingerprint as time-coded arrays (pair_time, pair_hash);
    feature is a digest of those arrays, so equal texts have equal features. Null text counts as empty: 192 spaces, which
    have no peak. doc_id may be null or repeat; rows are independent. Memory: the bytes of a text a few times; the transform
    works in blocks.
    """

    def make():
        schema = pa.schema(FIELDS + ARRAYS * arrays)

        def one(batch):
            rows = []
            for text in utf8(batch.column(1)):
                stored = wav(text + b" " * (-len(text) % HOP or (0 if text else HOP)))
                back = unwav(stored)
                times, codes = fingerprint(back)
                digest = hashlib.md5(times.astype("<i4").tobytes() + codes.astype("<i8").tobytes()).hexdigest()
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), digest, len(codes)) + ((stored, times, codes) if arrays else ()))
            columns = list(zip(*rows)) or [[]] * (len(schema) - 1)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

        return one

    return slim(docs, "doc_id", "text").mapInArrow(by_batch(make), DDL + ", media binary, pair_time array<int>, pair_hash array<bigint>" * arrays)


def described(stored: DataFrame) -> DataFrame:
    """The columns of FIELDS, but for doc_id and n_bytes all computed from stored files and arrays (doc_id, n_bytes, media, pair_time,
    pair_hash)."""

    def make():
        schema = pa.schema(FIELDS)

        def one(batch):
            rows = []
            for k in range(batch.num_rows):
                media, times, codes = batch.column(2)[k].as_py(), batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()
                back = unwav(media)
                digest = hashlib.md5(times.astype("<i4").tobytes() + codes.astype("<i8").tobytes()).hexdigest()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), digest, len(codes)))
            columns = list(zip(*rows)) or [[]] * (len(schema) - 2)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

        return one

    return stored.select("doc_id", "n_bytes", *(name for name, _ in ARRAYS)).mapInArrow(by_batch(make), DDL)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and the time-coded arrays are stored, and the columns come from what is read from there."""
    return described(store(media_columns(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", *(name for name, _ in ARRAYS)), "media"))


QUERIES = {"op2_media_columns": op2_media_columns}
ORACLE: dict[str, str] = {}
