"""Benchmark decontamination by greedy string tiling.

A document is compared with the items with which it shares a seed, a run of LEAST words: seeds of documents that can be an
item's, by a bit table of the items' seeds, are joined with these. Longest runs of words that both have, and that no earlier
tile covers, are marked again and again, found by running Karp-Rabin hashes; order doesn't matter, so a passage whose
sentences were moved about is caught too. An item whose words are covered by tiles to a share of COVER is contained in the
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.shared import stored
from sunfleet.llm.words import NOT_WORD, gram_hashes, list_array, slices, words_of

LEAST, COVER = 5, 0.8
#: The bit table has 64 bits for each seed, up to 16 MB; with more seeds it only lets more of the others through.
BITS_A_SEED, MOST_BITS = 64, 1 << 27
_B = 0x9E3779B97F4A7C15
#: Bits in a row of Spark's bitmap functions.
_BITMAP = 8 * 4096


class _Side:
    """The words of one text that no tile covers yet."""

    def __init__(self, words: np.ndarray, powers: np.ndarray):
        self.words, self.powers, self.free = words, powers, np.ones(len(words), bool)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers[: len(words)])])
        self.marked()

    def marked(self) -> None:
        self.taken = np.concatenate([[0], np.cumsum(~self.free)])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where free windows of `size` words begin, and their hashes."""
        at = np.flatnonzero(self.taken[size:] == self.taken[: len(self.taken) - size])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + size] - self.sums[at]) * self.powers[len(self.powers) - 1 - at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, length) of each tile, for word hashes of both.

    The longest free run that both have is found by halving: where there is none of a length, there is no longer one. All
    tiles of that length are marked, in the order of the item, each at the first place of the document that is free.
    """
    out: list[tuple[int, int, int]] = []
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(max(len(doc), len(item)) + 1, np.uint64(_B)))
    one, two = _Side(item, powers), _Side(doc, powers)

    def shared(size: int) -> tuple[np.ndarray, ...]:
        at, hashes = one.windows(size)
        at_doc, in_doc = two.windows(size)
        both = np.isin(hashes, in_doc)
        return at[both], hashes[both], at_doc, in_doc

    top = min(len(doc), len(item))
    while top >= least:
        low, high = least - 1, top  # a run of `low` words is shared, or too short to count; none longer than `high` is
        while low < high:
            middle = (low + high + 1) >> 1
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        at, hashes, at_doc, in_doc = shared(low)
        keep = np.isin(in_doc, hashes)
        places: dict[int, list[int]] = {}
        for h, j in zip(in_doc[keep][::-1].tolist(), at_doc[keep][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(j)  # the first place is the last of the list
        for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
            if not one.free[i : i + low].all():
                continue
            left, unlike = places[h], []
            while left:
                j = left.pop()
                if not two.free[j : j + low].all():
                    continue
                if np.array_equal(doc[j : j + low], item[i : i + low]):
                    two.free[j : j + low] = one.free[i : i + low] = False
                    out.append((i, j, low))
                    break
                unlike.append(j)  # the same hash by chance
            left.extend(unlike[::-1])
        one.marked()
        two.marked()
        top = low - 1
    return out


def item_seeds(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, words, k (words of a seed: LEAST, or all words of a shorter item) and seeds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = words_of(part.column("text"), NOT_WORD)
                size = np.minimum(words.counts(), LEAST)
                seeds = [np.zeros(0, np.uint64)] * part.num_rows
                for k in range(1, LEAST + 1):
                    grams = gram_hashes(words, k)
                    for i in np.flatnonzero(size == k):
                        seeds[i] = grams.hashes[grams.offsets[i] : grams.offsets[i + 1]]
                at = np.concatenate([[0], np.cumsum([len(s) for s in seeds])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(n + np.arange(part.num_rows)), part.column("item_id").cast(pa.int64()), list_array(words.hashes.view(np.int64), words.offsets, pa.int64()),
                        pa.array(size), list_array(np.concatenate(seeds).view(np.int64), at, pa.int64()),
                    ],
                    ["item", "item_id", "words", "k", "seeds"],
                )
                n += part.num_rows

    found = items.select("item_id", "text").mapInArrow(read, "item long, item_id long, words array<long>, k long, seeds array<long>")
    return found.where("k > 0")


def seed_bits(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(bit table of the seeds, the lengths of seeds): a byte string of a power of two of bits, MOST_BITS at most."""
    lengths = {row["k"]: row["n"] for row in seeds.groupBy("k").agg(F.sum(F.size("seeds")).alias("n")).toLocalIterator()}
    bits = _BITMAP
    while bits < min(MOST_BITS, BITS_A_SEED * sum(lengths.values())):
        bits *= 2
    each = seeds.select(F.explode("seeds").alias("seed")).select(F.pmod("seed", F.lit(bits)).alias("bit"))
    maps = each.groupBy(F.floor(F.col("bit") / _BITMAP).alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % _BITMAP).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for row in maps.toLocalIterator():
        table[row["row"] * 4096 : (row["row"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return table, sorted(lengths)


def seeded(docs: DataFrame, table: np.ndarray, lengths: list[int]) -> DataFrame:
    """For each row of docs and length k of seeds of which it has some: row (its number), doc_id, text_key, k, words and seeds.

    Only seeds that are in the bit table are there. words are those that they cover; where a document goes on with others, a
    0 stands between them.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((table, lengths))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = shipped.value
        mask = np.uint64(8 * len(table) - 1)
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = words_of(part.column("text"), NOT_WORD)
                for k in lengths:
                    grams = gram_hashes(words, k)
                    bit = grams.hashes & mask
                    hit = np.flatnonzero(table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    of = np.searchsorted(grams.offsets, hit, "right") - 1
                    # places among all words of the batch, with one before each text that keeps texts apart
                    place = hit - grams.offsets[of] + words.offsets[of] + of + 1
                    total = len(words.hashes) + part.num_rows
                    inside = np.zeros(total + k + 1, bool)
                    for j in range(k):
                        inside[place + j] = True
                    keep = inside[:total].copy()
                    keep[1:] |= inside[: total - 1]  # each stretch of seeds and the word after it
                    keep[words.offsets[:-1] + np.arange(part.num_rows)] = False
                    own = np.zeros(total, np.uint64)
                    own[np.arange(len(words.hashes)) + np.repeat(np.arange(part.num_rows) + 1, words.counts())] = words.hashes
                    own[~inside[:total]] = 0
                    rows = np.unique(of)
                    text = np.searchsorted(words.offsets + np.arange(part.num_rows + 1), np.flatnonzero(keep), "right") - 1
                    begin = np.searchsorted(text, np.append(rows, part.num_rows))
                    counts = np.searchsorted(of, np.append(rows, part.num_rows))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(n + rows), part.column("doc_id").take(pa.array(rows)), part.column("text_key").take(pa.array(rows)), pa.array(np.full(len(rows), k)),
                                list_array(own[keep].view(np.int64)[begin[0] : begin[-1]], begin - begin[0], pa.int64()),
                                list_array(grams.hashes[hit].view(np.int64), counts, pa.int64()),
                            ],
                            ["row", "doc_id", "text_key", "k", "words", "seeds"],
                        )
                n += part.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*_text_keys()).alias("text_key"))
    return rows.mapInArrow(read, f"row long, doc_id long, text_key {rows.schema['text_key'].dataType.simpleString()}, k long, words array<long>, seeds array<long>")


def _text_keys() -> list:
    """128 bits by which a text is known again."""
    return [F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")]


def _contained(docs: DataFrame, items: DataFrame, cover: float) -> DataFrame:
    """row, doc_id, text_key, item_id, coverage, n_tiles."""
    wanted = stored(item_seeds(items), "items")
    table, lengths = seed_bits(wanted)
    found = stored(seeded(docs, table, lengths), "seeded")
    seeds = wanted.select("item", "k", F.size("words").alias("n_words"), F.posexplode("seeds").alias("at", "seed"))
    mine = found.select("row", "k", F.explode(F.array_distinct("seeds")).alias("seed"))
    # the seeds that an item shares with a document cover at most k words each
    shared = mine.join(seeds, ["k", "seed"]).groupBy("row", "k", "item").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"))
    pairs = shared.where(F.col("n") * F.col("k") >= cover * F.col("n_words")).select("row", "k", "item")
    texts = pairs.join(found.select("row", "k", "doc_id", "text_key", F.col("words").alias("doc")), ["row", "k"])
    both = texts.join(wanted.select("item", "item_id", F.col("words").alias("own")), "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, owns = batch.column("doc"), batch.column("own")
            share, made = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for i in range(batch.num_rows):
                own = docs_[i].values.to_numpy().view(np.uint64), owns[i].values.to_numpy().view(np.uint64)
                got = tiles(*own, min(LEAST, len(own[1])))
                share[i], made[i] = sum(x[2] for x in got) / len(own[1]), len(got)
            kept = pa.array(share >= cover)
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("text_key"), batch.column("item_id"), pa.array(share), pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "text_key", "item_id", "coverage", "n_tiles"]).filter(kept)

    kind = found.schema["text_key"].dataType.simpleString()
    asked = both.select("row", "doc_id", "text_key", "item_id", "doc", "own")
    return asked.mapInArrow(tile, f"row long, doc_id long, text_key {kind}, item_id long, coverage double, n_tiles int")


def contained_items(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles: for each row of docs the items that it contains to a share of `cover` or more.

    Words are folded runs of ASCII letters, digits and non-ASCII characters; 64-bit hashes stand for them. Items or texts
    without words (null, empty) are in no row; repeated documents and items give repeated rows; null ids stay null; an
    empty table gives an empty table. Other columns are not read. An item with fewer than LEAST words has one seed, its whole.
    """
    return _contained(docs, items, cover).select("doc_id", "item_id", "coverage", "n_tiles")


def decontaminated(docs: DataFrame, items: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item. Equal texts stay or go together; null texts and ids stay."""
    gone = _contained(docs, items, cover).select(F.col("text_key.one").alias("__one"), F.col("text_key.two").alias("__two")).distinct()
    one, two = _text_keys()
    return docs.join(gone, (one == F.col("__one")) & (two == F.col("__two")), "left_anti")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
