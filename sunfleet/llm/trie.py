"""Elias-Fano n-gram trie in memory-mapped levels.

Words are numbers below `width`. Level k has its n-grams sorted by (parent, word). The words of all parents' children form
one monotone sequence, as each word is taken relative to its context: parent number * width + word. Both it and the
pointers (where each parent's children begin) are Elias-Fano coded: low bits in packed words, high bits in unary. A child
is found by a successor search between its parent's pointers. Probabilities are quantised to 16 bits of their logarithm.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64
_EVERY = 32  # ones, or zeros, between two samples of the select indexes
#: Codes of log10 probabilities: 0 is "absent", 1 to 65535 go from LOWEST to 0.
LOWEST, CODES = -13.0, 65535
_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th one of a byte, at byte * 8 + k; made from its definition.
_PLACE = np.zeros(2048, np.uint8)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    _PLACE[_byte * 8 : _byte * 8 + len(_ones)] = _ones


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities; 0 only for p = 0."""
    with np.errstate(divide="ignore"):
        x = np.rint((np.log10(p) - LOWEST) / -LOWEST * (CODES - 1)) + 1
    return np.where(p > 0, np.clip(x, 1, CODES), 0).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (LOWEST - LOWEST * (code.astype(np.float64) - 1) / (CODES - 1)), 0.0)


def _select(words: np.ndarray, samples: np.ndarray, flip: np.uint64, i: np.ndarray) -> np.ndarray:
    """Where the i-th one of `words` is (the i-th zero where `flip` is all ones): from the sample before it word by word, then
    by the running sums of a word's bytes."""
    start = samples[i // _EVERY]
    left = (i % _EVERY).astype(_U)
    word = start >> 6
    bits = (words[word] ^ flip) & (~_U(0) << (start & 63).astype(_U))
    ones = np.bitwise_count(bits).astype(_U)
    behind = np.flatnonzero(left >= ones)
    while len(behind):
        left[behind] -= ones[behind]
        word[behind] += 1
        found = words[word[behind]] ^ flip
        bits[behind] = found
        ones[behind] = np.bitwise_count(found)
        behind = behind[left[behind] >= ones[behind]]
    sums = bits - ((bits >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    shift = np.bitwise_count((((left * _BYTES) | _TOPS) - sums) & _TOPS).astype(_U) << _U(3)
    left -= ((sums << _U(8)) >> shift) & _U(0xFF)
    byte = (bits >> shift) & _U(0xFF)
    return (word << 6) + shift.astype(np.int64) + _PLACE[(byte << _U(3) | left).astype(np.int64)]


class EliasFano:
    """A monotone sequence of 64-bit values with vectorised access. parts() are the arrays to be stored."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.ones, self.zeros = n, low, lows, highs, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(_U), len(values)
        top = int(values[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = np.zeros(n * low // 64 + 2, _U)
        for at in range(0, n if low else 0, 1 << 16):  # piecewise, as each step has arrays of its own
            part = values[at : at + (1 << 16)] & _U((1 << low) - 1)
            bit = np.arange(at, at + len(part), dtype=_U) * _U(low)
            word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + _U(low) > _U(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        ones = (values >> _U(low)).astype(np.int64)
        ones += np.arange(n)
        flags = np.zeros(((int(ones[-1]) if n else 0) // 64 + 2) * 64, np.uint8)
        flags[ones] = 1
        highs = np.packbits(flags, bitorder="little").view(_U)
        return cls(n, low, lows, highs, ones[::_EVERY].astype(np.int64), np.flatnonzero(flags == 0)[::_EVERY])

    def parts(self) -> list[np.ndarray]:
        return [self.lows, self.highs, self.ones, self.zeros]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), _U)
        bit = i.astype(_U) * _U(self.low)
        word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        part = self.lows[word] >> shift
        over = np.flatnonzero(shift + _U(self.low) > _U(64))
        part[over] |= self.lows[word[over] + 1] << (_U(64) - shift[over])
        return part & _U((1 << self.low) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, _U)
        return (_select(self.highs, self.ones, _U(0), i) - i).astype(_U) << _U(self.low) | self._lows(i)

    def all(self) -> np.ndarray:
        """All values, read from first to last."""
        ones = np.flatnonzero(np.unpackbits(self.highs.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i).astype(_U) << _U(self.low) | self._lows(i)

    def successor(self, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each range the place of the first element that is not less than the value (end if there is none), and whether
        it is the value. Elements of one high part lie between two zeros of the unary code; among them low parts are halved."""
        if not self.n:
            return begin.copy(), np.zeros(len(begin), bool)
        last = 64 * len(self.highs) - self.n - 1  # the last zero: no element has a higher part
        high = np.minimum(value >> _U(self.low), _U(last)).astype(np.int64)
        beyond = high.astype(_U) != value >> _U(self.low)
        stop = _select(self.highs, self.zeros, ~_U(0), high) - high
        start = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        start[later] = _select(self.highs, self.zeros, ~_U(0), high[later] - 1) - (high[later] - 1)
        start = np.clip(start, begin, end)
        stop = np.where(beyond, end, np.clip(stop, start, end))
        start = np.where(beyond, end, start)
        part, top = value & _U((1 << self.low) - 1), stop.copy()
        open_ = np.flatnonzero(start < top)
        while len(open_):
            middle = (start[open_] + top[open_]) >> 1
            less = self._lows(middle) < part[open_]
            start[open_[less]] = middle[less] + 1
            top[open_[~less]] = middle[~less]
            open_ = open_[start[open_] < top[open_]]
        exact = start < stop
        exact[exact] = self._lows(start[exact]) == part[exact]
        return start, exact


class Trie:
    """roots are word numbers with exact counts; levels below have codes of probabilities given the context."""

    def __init__(self, width: int, roots: np.ndarray, counts: np.ndarray, below: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """below: for each level the parents' numbers (sorted), the words (sorted in a parent, under `width`) and probabilities."""
        self.width = _U(width)
        self._file = tempfile.TemporaryFile()
        sizes, arrays = [], []
        coded = [EliasFano.of(roots)]
        above = len(roots)
        for parents, words, _ in below:
            pointers = np.searchsorted(parents, np.arange(above + 1))
            coded += [EliasFano.of(pointers), EliasFano.of(parents.astype(_U) * self.width + words.astype(_U))]
            above = len(parents)
        for x in coded:
            arrays += x.parts()
        arrays += [counts.astype(np.int64), *[quantise(p) for _, _, p in below]]
        for a in arrays:
            a = np.ascontiguousarray(a)
            sizes.append((a.dtype, len(a), self._file.tell()))
            self._file.write(a.tobytes().ljust(-(-max(a.nbytes, 1) // 8) * 8, b"\0"))
        self._file.flush()
        self._map = mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self._map, d, n, at) for d, n, at in sizes]
        self.coded = [EliasFano(x.n, x.low, *views[4 * i : 4 * i + 4]) for i, x in enumerate(coded)]
        self.counts, self.codes = views[4 * len(coded)], views[4 * len(coded) + 1 :]

    def root(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the first level, -1 where a word is not there."""
        ids = self.coded[0]
        at, there = ids.successor(np.zeros(len(words), np.int64), np.full(len(words), ids.n), words.astype(_U))
        return np.where(there, at, -1)

    def child(self, level: int, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Numbers of the children `words` of nodes `parents` of the level above; -1 where there is no such child."""
        pointers, ids = self.coded[2 * level - 1], self.coded[2 * level]
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        if not len(known) or not ids.n:
            return out
        of, bounds = parents[known], pointers.all().astype(np.int64)
        at, there = ids.successor(bounds[of], bounds[of + 1], of.astype(_U) * self.width + words[known].astype(_U))
        out[known] = np.where(there, at, -1)
        return out

    def code(self, level: int, nodes: np.ndarray) -> np.ndarray:
        codes = self.codes[level - 1]
        return np.where(nodes >= 0, codes[np.maximum(nodes, 0)], 0).astype(np.uint16) if len(codes) else np.zeros(len(nodes), np.uint16)
