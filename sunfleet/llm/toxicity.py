"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, bigrams and bigrams with one word left out, hashed to 2**BITS coordinates. Each
coordinate has a learning rate of its own, and the L1 term leaves most weights at zero: what is broadcast is a sparse
vector of at most 2**BITS floats, whatever the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.words import NOT_WORD, gram_hashes, list_array, mix, slices, words_of

BITS = 18
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0
PASSES = 4
#: The bound on what is learned from: labelled texts, those with the smallest hashes, and their distinct features.
SAMPLE_ROWS, SAMPLE_FEATURES = 12_000, 12_000_000
THRESHOLD = 0.7
#: Place of the constant feature.
BIAS = 0


def feature_batches(batches: Iterator[pa.RecordBatch], bits: int = BITS, size: int = 1 << 20):
    """For each cut of a batch: the cut, the coordinates of all its texts and where each text's begin."""
    for batch in batches:
        for part in slices(batch, "text", size):
            words = words_of(part.column("text"), NOT_WORD)
            kinds = [words, gram_hashes(words, 2), gram_hashes(words, 2, (0, 2))]
            texts = np.arange(part.num_rows, dtype=np.uint64)
            with np.errstate(over="ignore"):
                keyed = [(k.hashes + np.uint64(977 * i)) >> np.uint64(64 - bits) | np.repeat(texts, k.counts()) << np.uint64(bits) for i, k in enumerate(kinds)]
            found = np.unique(np.concatenate([*keyed, texts << np.uint64(bits)]))  # the bias is in each text
            offsets = np.searchsorted(found, np.arange(part.num_rows + 1, dtype=np.uint64) << np.uint64(bits))
            yield part, (found & np.uint64((1 << bits) - 1)).astype(np.int32), offsets


def ftrl(labels: np.ndarray, features: np.ndarray, offsets: np.ndarray, bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Weights after `passes` over the rows in their order; an update touches the row's own coordinates only."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    free = np.full(1 << bits, L1)
    free[BIAS] = 0.0
    for _ in range(passes):
        for i, y in enumerate(labels):
            at = features[offsets[i] : offsets[i + 1]]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > free[at], -(zi - np.sign(zi) * free[at]) / ((BETA + root) / ALPHA + L2), 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
    root = np.sqrt(n)
    return np.where(np.abs(z) > free, -(z - np.sign(z) * free) / ((BETA + root) / ALPHA + L2), 0.0)


def learned_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and the other columns of labelled documents that may be learned from: crc32(doc_id as text) mod 3 is not 1.
    Documents with labels that contradict each other, or null ones, are left out."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    rows = docs.join(marks.select("doc_id", F.col("hi").alias("label")), "doc_id")
    return rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def _rank(ids: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int]]:
    """What rows are sorted by: a hash of the id, the id and a hash of the text."""
    with np.errstate(over="ignore"):
        mixed = mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return list(zip(mixed.tolist(), ids.tolist(), keys.tolist(), strict=True))


def first_rows(rows: Iterator[tuple[tuple, int, np.ndarray]], most: int) -> list[tuple[tuple, int, np.ndarray]]:
    """Of (rank, label, features) in any order: in the order of their ranks the longest run of rows from the first on that has
    at most `most` features. Not much more than these is held at a time."""
    held, size, stop = [], 0, None  # a heap, the last rank first
    for rank, label, found in rows:
        key = tuple(-x for x in rank)
        if stop is not None and key <= stop:
            continue
        heapq.heappush(held, (key, label, found))
        size += len(found)
        while size > most:
            stop, _, gone = heapq.heappop(held)
            size -= len(gone)
    return [(tuple(-x for x in key), label, found) for key, label, found in sorted(held, key=lambda x: x[0], reverse=True)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = SAMPLE_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the weights that are not zero.

    The sample is bounded: of the labelled (id, text) pairs the `rows` first ones by a hash of their ids, and of these, in the
    same order, as many as have `features` distinct features in all; they are learned from in that order, so that the
    weights don't depend on how the tables are dealt. Equal rows count once, other rows of one id each; a null id has no
    label, a null text is an empty one. One executor task holds the sample and learns. Without any labelled row, an empty
    table among them, all weights are zero.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    picked = learned_rows(texts.drop("text"), labels).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(rows)
    sample = texts.join(F.broadcast(picked), ["doc_id", "key"])  # `rows` rows of 20 bytes at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, offsets in feature_batches(batches):
            kept = [part.column("doc_id").cast(pa.int64()), part.column("key"), part.column("label").cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, list_array(found, offsets, pa.int32())], ["doc_id", "key", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                ids, keys, marks = (batch.column(c).to_numpy() for c in ("doc_id", "key", "label"))
                found = batch.column("features")
                at, values = found.offsets.to_numpy(), found.values.to_numpy()
                for i, rank in enumerate(_rank(ids, keys)):
                    yield rank, int(marks[i]), values[at[i] : at[i + 1]].copy()

        held = first_rows(each(), features)
        marks = np.array([label for _, label, _ in held], np.int32)
        found = np.concatenate([np.zeros(0, np.int32), *[x for _, _, x in held]])
        weights = ftrl(marks, found, np.concatenate([[0], np.cumsum([len(x) for _, _, x in held])]).astype(np.int64))
        places = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(weights[places])], ["place", "weight"])

    extracted = sample.select("doc_id", "key", "label", "text").mapInArrow(extract, "doc_id long, key long, label int, features array<int>")
    once = extracted.groupBy("doc_id", "key", "label").agg(F.first("features").alias("features"))
    found = once.repartition(1).mapInArrow(learn, "place int, weight double").toArrow()
    return found["place"].to_numpy(), found["weight"].to_numpy()


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], extra: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1, of the whole text; a null text is empty) and predicted (score >= THRESHOLD), then `extra`
    columns of docs as they are. Equal texts have equal scores; only the text is looked at, whatever its length. Repeated rows
    and null ids stay; an empty table gives an empty table."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    extra = extra or []
    rows = docs.select("doc_id", "text", *[c for c in extra if c != "text"])
    fields = [f for f in rows.schema.fields if f.name == "doc_id" or f.name in extra]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = shipped.value
        dense = np.zeros(1 << BITS)
        dense[places] = values
        for part, found, offsets in feature_batches(batches):
            margin = np.add.reduceat(dense[found], offsets[:-1]) if part.num_rows else np.zeros(0)
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
            kept = [part.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*[f.name for f in fields], "score", "predicted"])

    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def without_toxic(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted as toxic. Null and empty texts are scored like others."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[shipped.value[0]] = shipped.value[1]
        for part, found, offsets in feature_batches(batches):
            p = 1.0 / (1.0 + np.exp(-np.clip(np.add.reduceat(dense[found], offsets[:-1]), -35, 35)))
            yield part.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
