"""Best-fit packing with certified bin counts.

Pieces of documents are dealt to partitions of bounded size; each is packed best-fit decreasing, and lower bounds from
dual-feasible functions say how many bins it needs at least. A partition at its bound is done. The others keep their full
bins and exchange what lies in the rest: it is dealt anew, together, and packed again, as long as that saves bins. Each
piece carries its partition's number of bins and lower bound: where they are equal, the partition is certified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.shared import drop_stored, stored
from sunfleet.llm.tokens import NAME, Encoder
from sunfleet.llm.words import slices

CAPACITY, END = 2048, 0
#: Pieces that one task packs, under 2**20.
GROUP = 100_000
#: A round of exchange goes on to the next one where it saves at least one bin of so many.
ONE_OF = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = NAME) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut into pieces of `capacity` where they are
    more (the first piece takes the remainder)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, bounds = encoder.encode(part.column("text"), END)
                ids = ids.astype("<u4")
                rows: list[tuple] = []
                for i in range(part.num_rows):
                    begin, stop, k = int(bounds[i]), int(bounds[i + 1]), 0
                    at = begin
                    while at < stop:
                        size = (stop - at) % capacity or capacity
                        rows.append((i, k, at - begin, size, zlib.crc32(ids[at : at + size].tobytes())))
                        at, k = at + size, k + 1
                of, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                doc = part.column("doc_id").cast(pa.int64()).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions and the total length."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * sizes).sum()) // capacity)
    upper, volume = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * sizes)])
    for low in range(1, capacity // 2 + 1):  # over capacity - low: a bin each; under low: free
        whole = int(upper[capacity - low + 1]) if low else 0
        middle = int(volume[capacity - low + 1] - volume[low])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 41):  # sizes rounded up to a k-th, but for those that are whole multiples of 1 / (k + 1)
        exact = (sizes * (k + 1)) % capacity == 0
        value = np.where(exact, sizes * k, (sizes * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, by best-fit decreasing; equal lengths in their order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, made = 0, 0  # bit r of `some`: a bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            open_bins[left].append(b)
            some |= 1 << left
    return bins, offsets


def _pack(dealt: DataFrame, capacity: int) -> DataFrame:
    def pack(group: pa.Table) -> pa.Table:
        order = np.lexsort([group[c].to_numpy() for c in ("ids_crc32", "start", "piece", "doc_id")]) if not group["doc_id"].null_count else np.arange(group.num_rows)
        group = group.take(pa.array(order))
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        full = np.bincount(bins, lengths)[bins] == capacity
        made, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        columns = {"bin": bins, "offset": offsets, "full": full, "bins": np.full(len(bins), made), "bound": np.full(len(bins), bound)}
        for name, values in columns.items():
            group = group.append_column(name, pa.array(values))
        return group

    return dealt.groupBy("part").applyInArrow(pack, f"{PIECES}, part long, bin long, offset long, full boolean, bins long, bound long")


def _deal(rows: DataFrame, n: int, salt: int, group: int) -> DataFrame:
    parts = max(1, -(-n // group))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part"))


def _bins(packed: DataFrame) -> tuple[int, int, int]:
    """Bins, bound and rows; what is summed is a row for each partition."""
    parts = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count("*").alias("n"))
    row = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bins", "bound", "n")]).first()
    return row[0], row[1], row[2]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """Rows of PIECES with sequence_id and offset, and bins and bound of the partition where they were packed last: each
    sequence holds at most `capacity`, gapless from 0.

    Every row is placed; repeated rows and null ids are placed like others, and no row gives no sequence. Lengths are 1 to
    `capacity`; a piece of full capacity is a sequence, and a certified partition, of its own. Partitions with a gap (bins >
    bound) exchange documents for as many `rounds` as save one bin of ONE_OF or more; those whose bound is still lower then
    are in the result with their gap.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    one = F.lit(1).cast("long")
    whole = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("bins"), one.alias("bound"))
    rest = pieces.where(F.col("length") < capacity)
    now = stored(_pack(_deal(rest, rest.count(), 0, group), capacity), "packed")
    made, bound, _ = _bins(now)
    done, k = [], 0
    number = lambda df, k: df.select(*columns, (F.lit(k << 50) + F.shiftleft(F.col("part"), 20) + F.col("bin")).alias("sequence_id"), "offset", "bins", "bound")
    while made > bound and (rounds is None or k < rounds):
        k += 1
        gap = (F.col("bins") > F.col("bound")) & ~F.col("full")
        open_rows = now.where(gap)
        n = open_rows.count()
        before = open_rows.groupBy("part").agg(F.count_distinct("bin").alias("b")).agg(F.sum("b")).first()[0] or 0
        again = stored(_pack(_deal(open_rows, n, k, group), capacity), "packed")
        made, bound, _ = _bins(again)
        if made >= before:
            drop_stored(again)
            break
        done.append(number(now.where(~gap), k))
        now = again
        if (before - made) * ONE_OF < before:
            break
    done.append(number(now, k + 1))
    out = whole
    for part in done:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = NAME) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound: each row of docs in pieces, packed.

    A null or empty text is the end id alone; a null doc_id stays null. Other columns are not read. An empty table gives
    an empty table. Repeated rows are packed as often as they stand.
    """
    return pack(stored(pieces_of(docs, capacity, tokenizer), "pieces"), capacity)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
