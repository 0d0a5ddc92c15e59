"""LM scoring with an Elias-Fano n-gram trie.

The model is made and asked in shuffles of compact blocks. Documents are dealt to chunks; a chunk sends each shard the
distinct n-grams that fall to it, with the counts of those in learning texts. A shard adds the counts of all chunks, builds
its part of the trie and answers each chunk with quantised probabilities. The chunk then scores its texts. No task ever
holds more than about a chunk or a shard, whatever the corpus. An n-gram's shard is given by its first word; for frequent
first words by the first two; and by all three where both are as frequent as a whole shard.

A chunk sends at most FAN blocks: with more shards, the blocks go to groups of shards, are merged there, and are dealt on;
answers come back the same way. So blocks grow in proportion to the corpus, with a further hop for each factor of FAN. A
bundle that is merged has as many blocks as a chunk sends, so that it holds about a chunk.

Words are told apart by 64-bit hashes, in blocks as in the trie: the words of a bounded codebook, the CODEBOOK most frequent
ones, are sent as 16-bit codes and all others as their hashes.

Probabilities are those of a Dirichlet-smoothed trigram model: p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu), down to
(c(w) + 1) / (N + V + 1). What the trie holds of an n-gram is c(hw) / (c(h) + mu); for trigrams that are dealt by all three
words, whose context's count their shard doesn't know, it is the share in the first word's count, and the chunk brings it to
the context's. The count of a two-word context, which gives its weight, comes from that context's own quantised probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.shared import drop_stored, stored
from sunfleet.llm.trie import Trie, dequantise
from sunfleet.llm.words import Words, mix, slices, text_buffer, words_of

#: Pseudo-counts of the shorter context.
MU2, MU3 = 500.0, 20.0
#: Bytes of text of a chunk (one text at least) and tokens of a shard, about.
CHUNK_BYTES, SHARD_TOKENS = 4 << 20, 1_000_000
#: Blocks that a chunk, or a group of shards, sends at most.
FAN = 1024
#: Bigrams, or trigrams, that are looked up at once.
LOOKUPS = 1 << 16
#: Chunks, or shards, that a task works on one after another.
GROUPS_OF_TASK = 8
#: Words that are broadcast at most, with 20 bytes each; the code after the last one announces a hash.
CODEBOOK = (1 << 18) - 1
#: Words with fewer tokens are in no codebook. Others are in it from the first half power of two on from which there are no
#: more than CODEBOOK.
RARE = 32
#: Hashes that stand for the begin and the end of a text; no word has them but by a 64-bit collision.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_U = np.uint64


def _ints(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_arrays(arrays: list[np.ndarray], level: int = 1) -> bytes:
    small = [_ints(a) for a in arrays]
    head = np.array([x for a in small for x in (a.itemsize, len(a))], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([np.int64(len(small)).tobytes(), head.tobytes(), *[a.tobytes() for a in small]]))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for size, length in head.tolist():
        out.append(np.frombuffer(data, f"<u{size}", length, at))
        at += size * length
    return out


class Codebook:
    """The most frequent words of the learning texts, numbered from the most frequent one on: their hashes and counts, and the
    totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, ends: int, shards: int):
        order = np.lexsort([words, -counts])
        self.words, self.counts = words[order], counts[order]
        self.by_hash = np.argsort(self.words).astype(np.int32)
        self.total, self.distinct, self.ends, self.shards = total, distinct, ends, shards

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of words, CODEBOOK where they have none."""
        at = np.minimum(np.searchsorted(self.words, words, sorter=self.by_hash), max(len(self.words) - 1, 0))
        at = self.by_hash[at] if len(self.words) else np.zeros(len(words), np.int32)
        known = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        return np.where(known, at, CODEBOOK)

    def context_counts(self, number: np.ndarray) -> np.ndarray:
        """Counts as a context of the words of these numbers; 0 for words that have none."""
        padded = np.zeros(CODEBOOK + 1, np.int64)
        padded[: len(self.words)] = np.where(self.words == END, 0, self.counts)
        return padded[np.minimum(number, CODEBOOK)]


class Levels:
    """Distinct 1-, 2- and 3-grams in sorted order with their counts in learning texts. A word's number stands for its hash,
    words[number]; code has its number in the codebook. Parents are places in the level above."""

    def __init__(self, words: np.ndarray, code: np.ndarray, one: tuple, two: tuple, three: tuple):
        self.words, self.code = words, code
        (self.root, self.n1), (self.parent2, self.word2, self.n2), (self.parent3, self.word3, self.n3) = one, two, three

    def shards(self, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shard of each root, bigram and trigram."""
        n = _U(book.shards)
        first = self.words[self.root]
        with np.errstate(over="ignore"):
            home = first % n
            # at most 8 * shards words have an eighth of a shard's tokens or more, and at most `shards` words as many as a shard
            count = book.context_counts(self.code)
            own = self.root[self.parent2]
            spread2 = np.flatnonzero(count[own] >= max(1, book.total // (8 * book.shards)))
            shard2 = home[self.parent2]
            pair = mix(self.words[own] ^ (self.words[self.word2] * _U(0x9E3779B97F4A7C15)))
            shard2[spread2] = pair[spread2] % n
            self.spread3 = self.spread(book)
            spread3 = np.flatnonzero(self.spread3)
            shard3 = shard2[self.parent3]
            shard3[spread3] = mix(pair[self.parent3[spread3]] ^ (self.words[self.word3[spread3]] * _U(0xD6E8FEB86659FD93))) % n
        return home.astype(np.int64), shard2.astype(np.int64), shard3.astype(np.int64)

    def spread(self, book: Codebook) -> np.ndarray:
        """Whether a trigram is dealt by all of its words: its first two are each as frequent as a shard."""
        whole = book.context_counts(self.code) >= max(1, -(-book.total // book.shards))
        return (whole[self.root[self.parent2]] & whole[self.word2])[self.parent3]

    def dealt(self, book: Codebook, step: int, within: tuple[int, int] | None = None) -> Iterator[Part]:
        """Parts by target: shards' numbers are divided by `step`, and those of one quotient go together. `within` is the step
        and the quotient of the group in which this is; what is here only as a parent may have its home elsewhere."""
        home, to2, to3 = (s // step for s in self.shards(book))
        goes = [_ints(x) for x in (home, to2, to3)]  # narrow integers sort by radix
        order = [np.argsort(x, kind="stable") for x in goes]
        targets = np.flatnonzero(sum(np.bincount(x, minlength=book.shards // step + 1) for x in (home, to2, to3)))
        if within:
            targets = targets[targets // (within[0] // step) == within[1]]
        low = [np.searchsorted(x[o], targets, "left") for x, o in zip(goes, order, strict=True)]
        high = [np.searchsorted(x[o], targets, "right") for x, o in zip(goes, order, strict=True)]
        parent = np.zeros(len(self.root), bool)
        for k, target in enumerate(targets.tolist()):
            ones, twos, threes = (o[a[k] : b[k]] for o, a, b in zip(order, low, high, strict=True))
            away = threes[self.spread3[threes]]
            if len(away):
                twos = np.union1d(twos, self.parent3[away])
            parent[ones] = True
            parent[self.parent2[twos]] = True
            ones = np.flatnonzero(parent)
            parent[ones] = False
            yield Part(target, ones, twos, threes, home, to2)

    def request(self, part: Part) -> bytes:
        """The n-grams of a part and their counts. Roots and bigrams that stand there only as parents bring no counts."""
        own = np.concatenate([self.root[part.ones], self.word2[part.twos], self.word3[part.threes]])
        code = self.code[own]
        of2 = np.bincount(np.searchsorted(part.ones, self.parent2[part.twos]), minlength=len(part.ones))
        of3 = np.bincount(np.searchsorted(part.twos, self.parent3[part.threes]), minlength=len(part.twos))
        n1, n2 = self.n1[part.ones] * part.home1, self.n2[part.twos] * part.home2
        return pack_arrays([code & 0xFF, code >> 8 & 0xFF, code >> 16, self.words[own[code == CODEBOOK]], n1, of2, n2, of3, self.n3[part.threes]])


class Part:
    """What goes to one target: places of roots, bigrams and trigrams, and which of the first two are at home there."""

    def __init__(self, target: int, ones: np.ndarray, twos: np.ndarray, threes: np.ndarray, home: np.ndarray, to2: np.ndarray):
        self.target, self.ones, self.twos, self.threes = target, ones, twos, threes
        self.home1, self.home2 = home[ones] == target, to2[twos] == target


class Answers:
    """What comes back for Levels: counts of roots, codes of bigrams and trigrams."""

    def __init__(self, levels: Levels):
        self.count, self.code2, self.code3 = np.zeros(len(levels.root), np.int64), np.zeros(len(levels.word2), np.uint16), np.zeros(len(levels.word3), np.uint16)

    def take(self, part: Part, blob: bytes) -> None:
        count, code2, code3 = unpack_arrays(blob)
        self.count[part.ones[part.home1]] = count[part.home1]
        self.code2[part.twos[part.home2]] = code2[part.home2]
        self.code3[part.threes] = code3


def chunk_levels(words: Words, held_out: np.ndarray, book: Codebook) -> tuple[Levels, dict[str, np.ndarray]]:
    """The n-grams of a chunk's texts, and for each place of the texts (BEGIN, words, END) those that begin there, with where
    the texts begin and which places are tokens."""
    n_tokens = words.counts() + 1
    n, size = len(n_tokens), n_tokens + 1
    starts = np.concatenate([[0], np.cumsum(size)])
    seq = np.full(starts[-1], BEGIN, _U)
    seq[starts[1:] - 1] = END
    seq[np.arange(len(words.hashes)) + np.repeat(2 * np.arange(n) + 1, words.counts())] = words.hashes
    learned = np.repeat(~held_out, size)
    last = np.zeros(len(seq), bool)
    last[starts[1:] - 1] = True
    is_token = np.ones(len(seq), bool)
    is_token[starts[:-1]] = False

    hashes, one_of = np.unique(seq, return_inverse=True)
    n1 = np.bincount(one_of[learned & is_token], minlength=len(hashes))
    two = np.flatnonzero(~last)
    keys, at = np.unique(one_of[two].astype(_U) << _U(32) | one_of[two + 1].astype(_U), return_inverse=True)
    level2 = ((keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64), np.bincount(at[learned[two]], minlength=len(keys)))
    two_of = np.full(len(seq), -1, np.int64)
    two_of[two] = at
    three = two[~last[two + 1]]
    keys, at = np.unique(two_of[three].astype(_U) << _U(32) | one_of[three + 2].astype(_U), return_inverse=True)
    level3 = ((keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64), np.bincount(at[learned[three]], minlength=len(keys)))
    three_of = np.full(len(seq), -1, np.int64)
    three_of[three] = at
    levels = Levels(hashes, book.numbers(hashes), (np.arange(len(hashes)), n1), level2, level3)
    return levels, {"starts": starts, "is_token": is_token, "one_of": one_of, "two_of": two_of, "three_of": three_of, "n_tokens": n_tokens}


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and each key's place among them, as np.unique() has them, in half of its memory."""
    order = np.argsort(keys).astype(np.uint32)
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    own = ordered[first]
    del ordered
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return own, at


class Merged:
    """The n-grams of several blocks as one, and for each block where its own are."""

    def __init__(self, blobs: list[bytes], book: Codebook):
        asked = [unpack_arrays(b) for b in blobs]
        sizes = np.array([[len(a[4]), len(a[6]), len(a[8])] for a in asked], np.int64).reshape(-1, 3)
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *[a[k] for a in asked]], dtype=kind)
        # hashes that are not in the codebook have the numbers from CODEBOOK on; an n-gram's number takes 4 bytes, as there are a
        # few millions in a group of blocks, and what is no longer asked for is dropped at once: a worker's memory is made of these
        others, at = distinct(join(3, _U))
        number = join(2, np.uint32)
        number <<= 8
        number |= join(1, np.uint32)
        number <<= 8
        number |= join(0, np.uint32)
        number[number == CODEBOOK] = CODEBOOK + at.astype(np.uint32)
        kind = np.repeat(np.tile(np.arange(3, dtype=np.int8), len(asked)), sizes.ravel())
        level_of = [number[kind == level] for level in range(3)]
        del number, kind, at
        for a in asked:  # codes and hashes
            a[:4] = [None] * 4
        self.width = CODEBOOK + len(others) + 1
        words = np.zeros(self.width, _U)
        words[: len(book.words)] = book.words
        words[CODEBOOK:-1] = others
        merged, self.where, above = [], [], None
        for level, (of, n) in enumerate(((None, 4), (5, 6), (7, 8))):
            key, level_of[level] = level_of[level].astype(_U), None
            if of is not None:
                up = np.repeat(above, join(of, np.int64)).astype(_U)
                up *= _U(self.width)
                key += up
                del up
            own, above = distinct(key)
            del key
            total = np.bincount(above, join(n, np.float64), minlength=len(own)).astype(np.int64)
            word = (own % _U(self.width)).astype(np.int64)
            merged.append((word, total) if of is None else ((own // _U(self.width)).astype(np.int64), word, total))
            self.where.append(np.split(above, np.cumsum(sizes[:-1, level])) if len(asked) else [])
        self.levels = Levels(words, np.minimum(np.arange(self.width), CODEBOOK), *merged)

    def replies(self, count: np.ndarray, code2: np.ndarray, code3: np.ndarray) -> list[bytes]:
        return [pack_arrays([count[a], code2[b], code3[c]]) for a, b, c in zip(*self.where, strict=True)]


def answers(blobs: list[bytes], book: Codebook) -> list[bytes]:
    """What a shard answers to all blocks: for each, counts of roots and codes of bigrams and trigrams."""
    merged = Merged(blobs, book)
    x = merged.levels
    # counts as a context: of words in the codebook they are known, other words have all their bigrams here
    context = np.bincount(x.parent2, x.n2, minlength=len(x.root)).astype(np.int64)
    known = x.root < CODEBOOK
    context[known] = book.context_counts(x.root[known])
    share = x.n3 / (x.n2[x.parent3] + MU3)
    away = x.spread(book)
    share[away] = x.n3[away] / (context[x.parent2[x.parent3[away]]] + MU2)
    # only what learning texts hold goes into the trie, and what it hangs on
    keep3 = x.n3 > 0
    keep2 = x.n2 > 0
    keep2[x.parent3[keep3]] = True
    keep1 = x.n1 > 0
    keep1[x.parent2[keep2]] = True
    new1, new2 = np.cumsum(keep1) - 1, np.cumsum(keep2) - 1
    level2 = (new1[x.parent2[keep2]], x.word2[keep2], x.n2[keep2] / (context[x.parent2[keep2]] + MU2))
    trie = Trie(merged.width, x.root[keep1], x.n1[keep1], [level2, (new2[x.parent3[keep3]], x.word3[keep3], share[keep3])])
    del level2, share, away, keep3, keep2, keep1, new1, new2
    # each distinct n-gram is looked up once, for all blocks that ask for it
    node1 = trie.root(x.root)
    count = np.where(node1 >= 0, trie.counts[np.maximum(node1, 0)], 0) if len(trie.counts) else np.zeros(len(node1), np.int64)
    node2, code2, code3 = np.zeros(len(x.word2), np.int64), np.zeros(len(x.word2), np.uint16), np.zeros(len(x.word3), np.uint16)
    for at in range(0, len(node2), LOOKUPS):
        part = slice(at, at + LOOKUPS)
        node2[part] = trie.child(1, node1[x.parent2[part]], x.word2[part])
        code2[part] = trie.code(1, node2[part])
    for at in range(0, len(code3), LOOKUPS):
        part = slice(at, at + LOOKUPS)
        code3[part] = trie.code(2, trie.child(2, node2[x.parent3[part]], x.word3[part]))
    return merged.replies(count, code2, code3)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out: crc32(doc_id as text) mod 7 is 2; a null id is learned from."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False)).alias("held_out"))


def packed(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunk, blob for doc_id, text, held_out: rows that follow each other in a task, about `chunk_bytes` of text, are a chunk.

    A chunk is read twice, from one shuffle; should its task run again, it must read its rows in the same order, as scans of
    files do.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            raw, at = text_buffer(rows["text"])
            ids, known = rows["doc_id"].fill_null(0).to_numpy().view(_U), rows["doc_id"].is_valid().to_numpy()
            blob = pack_arrays([ids, known, rows["held_out"].to_numpy(), np.diff(at), raw], 6)
            return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            for part in slices(batch, "text", chunk_bytes // 8):
                held.append(part)
                size += part.column("text").nbytes
                if size >= chunk_bytes:
                    yield flush()
                    held, size, n = [], 0, n + 1
        if held:
            yield flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(pack, "chunk long, blob binary")


def unpacked(blobs: list[bytes]) -> pa.Table:
    """doc_id, text, held_out of blobs of packed()."""
    ids, known, out, size, raw = (np.concatenate(x) for x in zip(*map(unpack_arrays, blobs), strict=True))
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(raw))
    return pa.table({"doc_id": pa.array(ids.astype(_U).view(np.int64), mask=known == 0), "text": text, "held_out": pa.array(out.astype(bool))})


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (a hash), n: the tokens of all learning texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                keys, n = np.unique(words_of(part.column("text")).hashes, return_counts=True)
                held.append((np.append(keys, END), np.append(n, part.num_rows)))
                size += len(keys) + 1
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.where("not held_out").select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hops_of(shards: int, chunks: int, fan: int) -> tuple[list[int], list[int]]:
    """(steps, bundles): steps[k] shards are one target of the k-th hop, whose senders are bundled in bundles[k]. All hops deal
    to the same number of targets, `fan` at most, and as many blocks are in a bundle: a block is that part of its sender."""
    n = 1
    while fan**n < shards:
        n += 1
    even = max(2, round(shards ** (1 / n)))
    even += even**n < shards
    steps = [even**k for k in range(n - 1, -1, -1)]
    return steps, [max(1, chunks // even**k) for k in range(1, n)]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_tokens: int = SHARD_TOKENS, fan: int = FAN) -> DataFrame:
    """SCORES for each row of docs.

    Tokens are folded words between blanks and one end for each text; a null or empty text is its end alone. Without
    learning texts all counts are zero. Repeated rows count as often as they stand; a null id is learned from. Other
    columns are not read; an empty table gives an empty table. A text longer than a chunk is a chunk of its own size. Words
    are told apart by 64-bit hashes. Partitions must give their rows in the same order when they are read again.
    """
    spark = docs.sparkSession
    rows = marked(docs)
    # totals are observed while the words that can be in the codebook are stored
    seen = Observation()
    n_end = F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("n")))
    counted = vocabulary(rows).observe(seen, F.sum("n").alias("total"), F.count("*").alias("distinct"), n_end.alias("ends"))
    words = stored(counted.where(F.col("n") >= RARE), "vocabulary")
    total, distinct, ends = (seen.get.get(k) or 0 for k in ("total", "distinct", "ends"))
    octave = F.floor(F.log2(F.col("n")) * 2)  # words of half a power of two, at most 128 rows
    kept, least = 0, 128
    for row in words.groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).toLocalIterator():
        kept += row["count"]
        if kept >= CODEBOOK:
            break
        least = row["octave"]
    top = words.where(octave >= least).toArrow()
    drop_stored(words)
    shards = max(1, -(-total // shard_tokens))
    keys, counts = np.append(top["word"].to_numpy().view(_U), BEGIN), np.append(top["n"].to_numpy(), ends)
    model = spark.sparkContext.broadcast(Codebook(keys, counts, total, distinct, ends, shards))
    steps, bundles = hops_of(shards, 7 * total // chunk_bytes, fan)
    dealt = _over(packed(rows, chunk_bytes), 7 * total // (chunk_bytes * GROUPS_OF_TASK), "chunk")
    block = "target long, source long, blob binary"

    def table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["target", "source", "blob"])

    def ask(group: pa.Table) -> pa.Table:
        rows = unpacked(group["blob"].to_pylist())
        levels, _ = chunk_levels(words_of(rows["text"]), rows["held_out"].to_numpy().astype(bool), model.value)
        chunk = group["chunk"][0].as_py()
        return table([(p.target, chunk, levels.request(p)) for p in levels.dealt(model.value, steps[0])])

    def answer(group: pa.Table) -> pa.Table:
        blobs = answers(group["blob"].to_pylist(), model.value)
        return pa.table([group["target"], group["source"], pa.array(blobs, pa.binary())], names=["target", "source", "blob"])

    def relay(up: int, step: int):
        """Blocks of one target and bundle, merged and dealt on; the bundle is the sender of what goes out."""

        def run(key: tuple, group: pa.Table) -> pa.Table:
            target, bundle = (k.as_py() for k in key)
            levels = Merged(group["blob"].to_pylist(), model.value).levels
            return table([(p.target, bundle, levels.request(p)) for p in levels.dealt(model.value, step, (up, target))])

        return run

    def relay_back(up: int, step: int):
        def run(key: tuple, group: pa.Table, replies: pa.Table) -> pa.Table:
            merged = Merged(group["blob"].to_pylist(), model.value)
            found = Answers(merged.levels)
            by_target = dict(zip(replies["target"].to_pylist(), replies["blob"].to_pylist(), strict=True))
            for part in merged.levels.dealt(model.value, step, (up, key[0].as_py())):
                found.take(part, by_target[part.target])
            blobs = merged.replies(found.count, found.code2, found.code3)
            return pa.table([group["target"], group["source"], pa.array(blobs, pa.binary())], names=["target", "source", "blob"])

        return run

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts, book = unpacked(group["blob"].to_pylist()), model.value
        levels, at = chunk_levels(words_of(texts["text"]), texts["held_out"].to_numpy().astype(bool), book)
        by_target = dict(zip(replies["target"].to_pylist(), replies["blob"].to_pylist(), strict=True))
        found = Answers(levels)
        for part in levels.dealt(book, steps[0]):
            found.take(part, by_target[part.target])
        count, p2, p3 = found.count, dequantise(found.code2), dequantise(found.code3)
        context = np.where(levels.words == BEGIN, book.ends, np.where(levels.words == END, 0, count))
        # the count of a context of two words comes back from its own probability
        weight = context[levels.parent2] + MU2
        pairs = np.rint(p2 * weight)
        away = levels.spread3
        p3[away] *= (weight / (pairs + MU3))[levels.parent3[away]]
        base = (count + 1) / (book.total + book.distinct + 1)
        token = np.flatnonzero(at["is_token"])
        before = token - 1
        own = at["one_of"][token]
        # p(w | v) and then p(w | u, v)
        whole = p2[at["two_of"][before]] + MU2 / (context[at["one_of"][before]] + MU2) * base[own]
        third = np.flatnonzero(at["is_token"][before])
        two = at["two_of"][before[third] - 1]
        whole[third] = p3[at["three_of"][before[third] - 1]] + MU3 / (pairs[two] + MU3) * whole[third]
        starts = at["starts"][:-1] - np.arange(len(texts))
        add = lambda x: np.add.reduceat(x, starts)
        columns = [
            texts["doc_id"], texts["held_out"], pa.array(at["n_tokens"]), pa.array(add((count[own] > 0).astype(np.int64))),
            pa.array(np.full(len(texts), book.total, np.int64)), pa.array(add(np.log10(base[own]))), pa.array(add(np.log10(whole))),
        ]
        return pa.table(columns, names=[x.split(" ")[0] for x in SCORES.split(", ")])

    hops = [dealt.groupBy("chunk").applyInArrow(ask, block)]
    tasks = shards // GROUPS_OF_TASK
    bundle = lambda n: F.pmod(F.xxhash64("source"), F.lit(n)).alias("bundle")
    for up, step, n in zip(steps, steps[1:], bundles, strict=False):
        hops.append(hops[-1].groupBy("target", bundle(n)).applyInArrow(relay(up, step), block))
    replies = _over(hops[-1], tasks, "target").groupBy("target").applyInArrow(answer, block)
    for hop, up, step, n in zip(hops[-2::-1], steps[-2::-1], steps[:0:-1], bundles[::-1], strict=True):
        sent = replies.groupBy(F.floor(F.col("target") / (up // step)).alias("target"), F.col("source").alias("bundle"))
        replies = hop.groupBy("target", bundle(n)).cogroup(sent).applyInArrow(relay_back(up, step), block)
    return dealt.groupBy("chunk").cogroup(replies.groupBy(F.col("source").alias("chunk"))).applyInArrow(score, SCORES)


def _over(df: DataFrame, tasks: int, column: str) -> DataFrame:
    """df by `column`, over more tasks than the session's number of shuffle partitions where the corpus needs them."""
    return df.repartition(tasks, column) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
