"""Token counts of flat, unindexed token files by a separator scan.

A file is 16-bit ids, one document after another, each ended by one identifier; nothing says where documents begin. Blocks
of a file are searched for the identifier on their own, by whole-array comparison. A block knows the tokens before its
first separator, between separators and after its last; a prefix scan over the blocks of a file carries the open tokens
and the number of documents from block to block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunfleet.llm.shared import new_path, stored
from sunfleet.llm.tokens import NAME, Encoder
from sunfleet.llm.words import slices

#: The vocabulary's own end-of-document id; texts are encoded so that it stands for nothing else.
END = 50256
BLOCK, FILE_TOKENS = 1 << 20, 1 << 23


def write_token_files(docs: DataFrame, path: str, tokenizer: str = NAME, end: int = END, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the texts to files of about `file_tokens` ids below `path`; returns file, n_ids and the doc_ids in the file's order.

    `path` is a folder that all executors and the driver share. Names are new in every attempt of a task; a file counts only
    if the returned table names it. A null text is an empty one.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        encoder, held, names, size = Encoder(tokenizer), [], [], 0

        def flush() -> pa.RecordBatch:
            file = f"{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{folder}/{file}") as out:
                for x in held:
                    out.write(x.tobytes())
            ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["file", "n_ids", "doc_ids"])

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, _ = encoder.encode(part.column("text"), end, special=False)
                held.append(ids.astype("<u2"))
                names.append(part.column("doc_id"))
                size += len(ids)
                if size >= file_tokens:
                    yield flush()
                    held, names, size = [], [], 0
        if size:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(write, "file string, n_ids long, doc_ids array<long>"), "token-files")


def scan_blocks(files: DataFrame, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, block, n_ids, n_ends, head (ids before the first end), inner (lengths between ends), tail (ids after the last)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, k, n in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "n_ids")], strict=True):
                with store.open_input_file(f"{folder}/{file}") as source:
                    source.seek(2 * k * block)
                    ids = np.frombuffer(source.read(2 * min(block, n - k * block)), "<u2")
                ends = np.flatnonzero(ids == end)
                head, tail = (int(ends[0]), len(ids) - 1 - int(ends[-1])) if len(ends) else (0, len(ids))
                inner = pa.ListArray.from_arrays(pa.array([0, max(0, len(ends) - 1)], pa.int32()), pa.array(np.diff(ends) - 1, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([k]), pa.array([len(ids)]), pa.array([len(ends)]), pa.array([head]), inner, pa.array([tail])],
                    ["file", "block", "n_ids", "n_ends", "head", "inner", "tail"],
                )

    n_blocks = F.ceil(F.col("n_ids") / block).cast("long")
    blocks = files.where("n_ids > 0").select("file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    return blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, n_ids long, n_ends long, head long, inner array<long>, tail long")


def stitch(blocks: DataFrame) -> DataFrame:
    """file, ordinal (from 0), n_tokens, ended: the documents of each file. Ids after a file's last end are a document that
    is not ended."""
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    ended = blocks.withColumns(
        {
            "first": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
            "run": F.sum((F.col("n_ends") > 0).cast("long")).over(upto),
        }
    )
    run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = ended.withColumn("open", F.sum("tail").over(run)).withColumn("carry", F.coalesce(F.lag("open").over(in_order), F.lit(0)))
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    whole = carried.where("n_ends > 0").select("file", "first", F.posexplode(lengths).alias("at", "n_tokens"))
    whole = whole.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    left = carried.groupBy("file").agg(F.max_by("open", "block").alias("n_tokens"), F.sum("n_ends").alias("ordinal")).where("n_tokens > 0")
    return whole.unionByName(left.select("file", "ordinal", "n_tokens", F.lit(False).alias("ended")))


def token_counts(docs: DataFrame, block: int = BLOCK, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """doc_id, n_tokens (without the end): docs are written as flat files, and counted by reading these.

    Null or empty texts have 0 tokens; null ids and repeated rows stay; other columns are not read; an empty table gives an
    empty table.
    """
    path = new_path(docs.sparkSession, "flat")
    files = write_token_files(docs, path, file_tokens=file_tokens)
    counted = stitch(stored(scan_blocks(files, path, block=block), "blocks"))
    names = files.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
