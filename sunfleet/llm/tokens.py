"""Byte-level BPE ids of whole text columns.

Byte-level BPE never merges over the start of a blank that has no other blank beside it, so a text is cut there and each
distinct piece is encoded once for a task. The ids are those of the tokenizer file; texts that hold the string of a
special token, for which the cuts do not hold, are given to the tokenizer itself.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from sunfleet.llm.words import range_hashes, text_buffer

NAME = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Pieces, and bytes of them, that a task remembers at most; then it begins anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 1 << 26
_BLANK = np.zeros(256, bool)
_BLANK[:0x21] = True
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True


class Encoder:
    """ids of texts by the tokenizer files <name>.json and <name>.tiktoken, whose vocabularies are one."""

    def __init__(self, name: str = NAME):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.name, self.whole = name, None
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bytes_at, self.bytes_n, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _slow(self, text: str) -> list[int]:
        if self.whole is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
        return self.whole.encode(text, add_special_tokens=False).ids

    def _remember(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes pieces that were not met before. Those that begin with a blank and end without one keep their cuts when
        they are joined, and go through the encoder together."""
        joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] in b" \n" and p[1] > 0x20 and p[-1] > 0x20]
        counts, found = np.zeros(len(pieces), np.int64), {}
        whole = np.array(self.fast.encode_ordinary(b"".join([pieces[i] for i in joined]).decode()), np.uint32)
        ends = np.searchsorted(np.cumsum(self.sizes[whole]), np.cumsum([len(pieces[i]) for i in joined])) + 1 if joined else np.zeros(0, np.int64)
        counts[joined] = np.diff(ends, prepend=0)
        for i in set(range(len(pieces))) - set(joined):
            found[i] = np.array(self.fast.encode_ordinary(pieces[i].decode()), np.uint32)
            counts[i] = len(found[i])
        starts = np.zeros(len(pieces), np.int64)
        starts[joined] = self.used + ends - counts[joined]
        at = self.used + len(whole)
        for i, ids in found.items():
            starts[i], at = at, at + len(ids)
        if at > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(at, len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(whole)] = whole
        for i, ids in found.items():
            self.pool[starts[i] : starts[i] + len(ids)] = ids
        self.used = at
        keys = np.concatenate([self.known, hashes])
        order = np.argsort(keys, kind="stable")
        self.known, self.start, self.count = keys[order], np.concatenate([self.start, starts])[order], np.concatenate([self.count, counts])[order]
        size = np.array([len(p) for p in pieces], np.int64)
        self.bytes_at = np.concatenate([self.bytes_at, len(self.bytes) + np.cumsum(size) - size])[order]
        self.bytes_n = np.concatenate([self.bytes_n, size])[order]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])

    def _differing(self, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The pieces raw[begin:stop] that are not, byte by byte, the remembered pieces `of`."""
        n = stop - begin
        other = n != self.bytes_n[of]
        same = np.flatnonzero(~other)
        for i in range(0, len(same), 1 << 16):
            own = same[i : i + (1 << 16)]
            size = n[own]
            ends = np.cumsum(size)
            inner = np.arange(ends[-1])
            here = raw[inner + np.repeat(begin[own] - (ends - size), size)]
            wrong = np.flatnonzero(here != self.bytes[inner + np.repeat(self.bytes_at[of[own]] - (ends - size), size)])
            other[own[np.searchsorted(ends, wrong, "right")]] = True
        return np.flatnonzero(other)

    def encode(self, column: pa.Array, end: int | None = None, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (uint32), one after another, and where each text's begin; `end` is put after each text. A null
        text is an empty one. Without `special` the special tokens' strings in a text are ordinary text."""
        raw, at = text_buffer(column)
        n = len(at) - 1
        if len(raw):
            inner = np.zeros(len(raw), bool)
            inner[1:-1] = _CUT[raw[1:-1]] & ~_BLANK[raw[:-2]] & ~_BLANK[raw[2:]]
            inner[at[:-1][at[:-1] < len(raw)]] = True
            lasts = at[1:][np.diff(at) > 0] - 1
            single = lasts[np.diff(at)[np.diff(at) > 0] > 1]
            inner[single] = False
            begin = np.flatnonzero(inner)
            stop = np.append(begin[1:], len(raw))
            hashes = range_hashes(raw, begin, stop)
            distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > REMEMBERED or len(self.bytes) > REMEMBERED_BYTES:
                self._forget()
            place = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = place < len(self.known)
            new[inside] = self.known[place[inside]] != distinct[inside]
            if new.any():
                data = raw.tobytes()
                self._remember(distinct[new], [data[b:e] for b, e in zip(begin[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
                place = np.searchsorted(self.known, distinct)
            of = place[where]
            starts, counts = self.start[of], self.count[of]
            other = self._differing(raw, begin, stop, of)
            if len(other):  # a hash of other bytes: these pieces are encoded by themselves
                own = [np.array(self.fast.encode_ordinary(raw[b:e].tobytes().decode()), np.uint32) for b, e in zip(begin[other], stop[other], strict=True)]
                counts[other] = [len(x) for x in own]
                starts[other] = self.used + np.cumsum(counts[other]) - counts[other]
                self.pool = np.concatenate([self.pool[: self.used], *own])
                self.used = len(self.pool)
            sums = np.concatenate([[0], np.cumsum(counts)])
            bounds = sums[np.searchsorted(begin, at)]
        else:
            starts = counts = np.zeros(0, np.int64)
            sums, bounds = np.zeros(1, np.int64), np.zeros(n + 1, np.int64)
        ids = self.pool[np.arange(sums[-1]) + np.repeat(starts - sums[:-1], counts)]
        # special strings: the whole tokenizer has its say
        slow = {}
        if special and SPECIAL.encode() in raw.tobytes():
            slow = {i: np.array(self._slow(x), np.uint32) for i, x in enumerate(column.to_pylist()) if x and SPECIAL in x}
        if not slow and end is None:
            return ids, bounds
        if slow:
            parts = [slow.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(n)]
            ids, bounds = np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(n + 1)
        return ids, bounds
