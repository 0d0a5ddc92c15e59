"""Words of Arrow text batches as 64-bit hashes, by whole-buffer NumPy operations: no Python object is made per word."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words are hashed one by one; shorter ones eight bytes at a time, all words of a piece together.
LONG_WORD = 64
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _table(separators) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: Separators of words [^\x20\x09-\x0D]+ and of words of ASCII letters, digits and all non-ASCII characters (A-Z are folded first).
SPACES = _table([0x20, *range(0x09, 0x0E)])
NOT_WORD = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection, so it makes no collisions."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """hashes of all words, one text after another; text i has the words offsets[i] to offsets[i + 1]."""

    hashes: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each text starts in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes that are worked on at a time, so that the intermediate arrays stay in the processor's cache.
_PIECE = 1 << 17


def byte_hashes(padded: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of padded[begin:end] for ranges of any place and length; `padded` has eight bytes more than the ranges use.

    Eight bytes at a time are mixed into the state, so that ranges of one length up to eight bytes never collide and others
    do by chance only; ranges over LONG_WORD have their blake2b digest.
    """
    n = end - begin
    lanes = np.ndarray((max(len(padded) - 7, 0),), "<u8", np.ascontiguousarray(padded).data, strides=(1,))
    out = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _BASE)
    if not len(n):
        return out
    out = mix(out ^ (lanes[begin] & _LANE[np.minimum(n, 8)]))
    short = np.flatnonzero((n > 8) & (n <= LONG_WORD))
    for lane in range(8, LONG_WORD, 8):
        if not len(short):
            break
        out[short] = mix(out[short] ^ (lanes[begin[short] + lane] & _LANE[np.minimum(n[short] - lane, 8)]))
        short = short[n[short] > lane + 8]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(padded[begin[i] : end[i]].data, digest_size=8).digest(), "little")
    return out


def _piece(raw: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros(len(raw) + 8, np.uint8)
    folded = padded[: len(raw)]
    np.take(_FOLD, raw, out=folded)
    inside = ~separators[folded]
    turn = np.empty(len(raw) + 1, bool)
    turn[0], turn[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
    edges = np.flatnonzero(turn)
    begin, end = edges[::2], edges[1::2]
    inner = at[(at > 0) & (at < len(raw))]
    inner = inner[inside[inner] & inside[inner - 1]]  # words don't run on from one text into the next
    if len(inner):
        inner = np.unique(inner)
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
    return byte_hashes(padded, begin, end), begin


def words_of(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    """The words of each text, A-Z folded. A word's hash is that of its bytes, by byte_hashes()."""
    raw, at = text_buffer(column)
    hashes, counts, i, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0, len(at) - 1
    with np.errstate(over="ignore"):
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + _PIECE, "right")) - 1))
            own = at[i : j + 1] - at[i]
            if own[-1]:
                found, begin = _piece(raw[at[i] : at[j]], own, separators)
                hashes.append(found)
                counts.append(np.diff(np.searchsorted(begin, own)))
            else:
                counts.append(np.zeros(j - i, np.int64))
            i = j
    return Words(np.concatenate(hashes), np.cumsum(np.concatenate(counts)))


def gram_hashes(words: Words, k: int, gaps: tuple[int, ...] | None = None) -> Words:
    """Hashes of the k-grams of each text; with gaps, of the words that stand at those distances from the first."""
    places = gaps or tuple(range(k))
    span, n = places[-1] + 1, len(words.hashes)
    per_text = np.maximum(words.counts() - (span - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    if n < span or not offsets[-1]:
        return Words(np.zeros(0, np.uint64), offsets)
    out = np.zeros(n - span + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in places:
            out = (out + words.hashes[j : n - span + 1 + j]) * _BASE
            out ^= out >> np.uint64(29)
    keep = np.arange(offsets[-1]) - np.repeat(offsets[:-1], per_text) + np.repeat(words.offsets[:-1], per_text)
    return Words(mix(out[keep]), offsets)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Cuts a batch so that each cut has about `size` bytes of text, one row at least."""
    _, at = text_buffer(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def range_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[begin:end] for sorted ranges that don't overlap, the same for equal bytes wherever they stand."""
    out, i = np.empty(len(begin), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + _PIECE, "right")))
            padded = np.zeros(end[j - 1] - begin[i] + 8, np.uint8)
            padded[:-8] = raw[begin[i] : end[j - 1]]
            out[i:j] = byte_hashes(padded, begin[i:j] - begin[i], end[i:j] - begin[i])
            i = j
    return out
