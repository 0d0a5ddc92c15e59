"""Media columns: payloads as WAV bytes, read back by the wave module, with short-time Fourier transforms and fingerprints
of spectral-peak pairs as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.words import list_array, slices

RATE = 8000
#: Samples of a frame and between frames; the last frame is filled up with silence.
FRAME, HOP = 256, 128
#: Peaks kept in a frame, frames that a pair may span, and pairs that start from a peak.
PEAKS, REACH, FAN = 2, 16, 3
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Frames that are transformed at a time.
_FRAMES = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as 8-bit mono samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of 8-bit mono media."""
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return file.readframes(file.getnframes()), file.getframerate()


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the PEAKS loudest local maxima of each frame's spectrum, by frame and then from loud to soft. A frame
    of silence or of one constant value has none."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    n = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    at, of = [], []
    for i in range(0, n, _FRAMES):
        part = frames[i : i + _FRAMES]
        spectrum = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)).astype(np.float32)
        inner = spectrum[:, 1:-1]
        top = (inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]) & (inner > 1e-3)
        loud = np.where(top, inner, np.float32(0))
        best = np.argsort(-loud, axis=1, kind="stable")[:, :PEAKS]
        found = np.take_along_axis(loud, best, axis=1) > 0
        row, col = np.nonzero(found)
        at.append(row + i)
        of.append(best[row, col] + 1)
    return np.concatenate(at), np.concatenate(of)


def landmarks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time, code): for each pair of a peak and one of the FAN next peaks in later frames within REACH, the first one's frame
    and (bin, bin, distance) in one number."""
    at, of = peaks(samples)
    times, codes = [], []
    first_later = np.searchsorted(at, at, "right")
    for k in range(FAN):
        other = first_later + k
        ok = other < len(at)
        i, j = np.flatnonzero(ok), other[ok]
        near = at[j] - at[i] <= REACH
        i, j = i[near], j[near]
        times.append(at[i])
        codes.append((of[i] << 16) | (of[j] << 8) | (at[j] - at[i]))
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort([codes, times])
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: these and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, times,
    codes, and with keep_media the stored `media` itself.

    All but n_bytes and doc_id come from the stored bytes, read again. Equal texts have equal values; a null text is an empty
    one. feature names the number of frames and pairs and the digest of the time-coded arrays. Repeated rows and null ids
    stay; other columns are not read; an empty table gives an empty table. A text is worked on in blocks of frames.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows, times, codes, stored = [], [], [], []
                for text in part.column("text").to_pylist():
                    n, payload = payload_of(text)
                    media = to_wav(payload)
                    samples, _ = read_wav(media)
                    t, c = landmarks(samples)
                    digest = hashlib.sha256(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
                    frames = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
                    rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{frames}:{len(t)}:{digest}"))
                    times.append(t)
                    codes.append(c)
                    stored.append(media)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [part.column("doc_id"), *[pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in times])])
                columns += [list_array(np.concatenate(x), offsets, pa.int32()) for x in (times, codes)]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
                if keep_media:
                    columns.append(pa.array(stored, pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(make, fields + (", media binary" if keep_media else ""))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
