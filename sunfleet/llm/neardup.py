"""MinHash near-duplicates with tensored banding.

Two collections of m half-bands, each of r minhashes, give m * m table keys by pairing every half-band of the one with
every half-band of the other: 2 * m * r minhashes do the work of m * m * 2r. Documents that meet under a key are compared
with the key's hub (its member that meets most others); pairs of members are not made. What the comparison with the
hub leaves open is found by a prefix join on the differences from the hub: if H(A, B) is the number of shingles that only
one of A and B has, then J(A, B) >= t means H(A, B) <= (1 - t) / (1 + t) * (|A| + |B|), and H(A, B) = |A^hub| + |B^hub| -
2 |A^hub & B^hub|. So A and B share so many elements of their differences that one is among the first few of each.
Every link that is reported is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunfleet.llm.components import components
from sunfleet.llm.shared import drop_stored, salted_join, stored
from sunfleet.llm.words import Words, gram_hashes, list_array, mix, slices, words_of

SHINGLE = 5


def plan_tables(percent: int, miss: float = 5e-4) -> tuple[int, int]:
    """(r, m): minhashes in a half-band and half-bands in a collection, so that a pair at the threshold meets under
    some key but for a share of about 2 * miss."""
    r = 3 if percent >= 85 else 2
    p = (percent / 100) ** r
    return r, math.ceil(math.log(miss) / math.log(1 - p)) if p < 1 else 1


def shingle_sets(column: pa.Array) -> Words:
    """Sorted distinct shingles of each text; with 1 to 4 words the whole sequence is the one shingle."""
    words = words_of(column)
    grams = gram_hashes(words, SHINGLE)
    counts, per_text = words.counts(), grams.counts()
    parts, sizes = [], np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        for i, n in enumerate(counts):
            if n >= SHINGLE:
                own = np.unique(grams.hashes[grams.offsets[i] : grams.offsets[i] + per_text[i]])
            elif n:
                x = np.uint64(n)
                for w in words.hashes[words.offsets[i] : words.offsets[i + 1]]:
                    x = (x + w) * np.uint64(0x9E3779B97F4A7C15)
                    x ^= x >> np.uint64(29)
                own = mix(np.array([x], np.uint64))
            else:
                continue
            parts.append(own)
            sizes[i] = len(own)
    return Words(np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]))


def _coefficients(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, r: int, m: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (a 128-bit fingerprint of the set), halves: 2 * m half-band hashes."""
    n = 2 * m * r

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _coefficients(n)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                sizes = sets.counts()
                full = np.flatnonzero(sizes)
                starts = sets.offsets[:-1][full]
                halves = np.zeros((part.num_rows, 2 * m), np.uint64)
                fps = np.zeros((part.num_rows, 2), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        for band in range(2 * m):
                            key = np.full(len(full), band, np.uint64)
                            for j in range(band * r, band * r + r):
                                key = mix(key * mul[j] + np.minimum.reduceat(sets.hashes * mul[j] + add[j], starts))
                            halves[full, band] = key
                        for c in range(2):
                            fps[full, c] = np.add.reduceat(mix(sets.hashes + np.uint64(c + 1)), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(fps[:, 0].view(np.int64)), pa.array(fps[:, 1].view(np.int64)),
                        list_array(halves.ravel().view(np.int64), np.arange(part.num_rows + 1) * 2 * m, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "halves"],
                )

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, halves array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """class, own: the sorted shingles of each row of doc_id, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), list_array(sets.hashes.view(np.int64), sets.offsets, pa.int64())], ["class", "own"])

    return docs.mapInArrow(read, "class long, own array<long>")


def _linked(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return shared * 100 >= (n_a + n_b - shared) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("class").alias("a"), F.col("own").alias("own_a"))
    b = sets.select(F.col("class").alias("b"), F.col("own").alias("own_b"))
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return pairs.join(a, "a").join(b, "b").where(_linked(shared, F.size("own_a"), F.size("own_b"), percent)).select(*pairs.columns)


def linked_components(docs: DataFrame, signed: DataFrame, m: int, percent: int) -> DataFrame:
    """node, component of classes that have links; a class is all documents of one shingle set, named by its smallest doc_id.

    Links to hubs come first, and their components; then the links that join two of these components. What is between
    members of one component already changes nothing, so that groups of near copies, however large, make no pairs.
    """
    classes = signed.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("class"), F.first("halves").alias("halves")).where("class is not null")
    index = F.sequence(F.lit(0), F.lit(m - 1))
    keys = F.flatten(
        F.transform(index, lambda i: F.transform(index, lambda j: F.xxhash64(i * m + j, F.get("halves", i), F.get("halves", j + m))))
    )
    rows = classes.select("class", F.explode(keys).alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(rows.join(many, "key"), "met")
    central = met.groupBy("class").agg(F.sum("n").alias("weight"))
    hubs = met.join(central, "class").groupBy("key").agg(F.max_by("class", F.struct("weight", -F.col("class"))).alias("hub"))
    star = stored(met.join(hubs, "key").where("class != hub").select("hub", "class").distinct(), "star")
    wanted = star.select("class").union(star.select("hub")).distinct()
    sets = stored(sets_of(docs.join(wanted.withColumnRenamed("class", "doc_id"), "doc_id").select("doc_id", "text")), "sets")

    ratio = (100 - percent) / (100 + percent)
    own, hub = F.col("own"), F.col("own_hub")
    n, n_hub = F.size(own), F.size(hub)
    # differences from the hub: first what the member has more, then what it lacks, each in the order of the hashes
    more = F.array_except(own, hub)
    shared = n - F.size(more)
    h = F.floor(n * (1 + 100 / percent) * ratio + 1e-6).cast("int")
    hub_sets = sets.select(F.col("class").alias("hub"), own.alias("own_hub"))
    spread = salted_join(star.join(sets, "class"), hub_sets, "hub", F.col("class")).select(
        "hub", "class", n.alias("n"), n_hub.alias("n_hub"), h.alias("h"), own, hub, more.alias("more"), shared.alias("shared")
    )
    lacks = F.array_except(hub, own)
    size = F.col("n") + F.col("n_hub") - 2 * F.col("shared")
    differences = stored(
        spread.select(
            "hub", "class", "n", "h", size.alias("size"), _linked(F.col("shared"), F.col("n"), F.col("n_hub"), percent).alias("linked"),
            F.floor((F.col("n") * (percent / 100) + F.col("n_hub")) * ratio - 1e-6).alias("open_from"),
            F.slice(F.concat("more", lacks), 1, F.col("h") + 1).alias("first"),
        ),
        "differences",
    )
    direct = differences.where("linked").select(F.col("class").alias("a"), F.col("hub").alias("b"))

    near = components(direct)
    of = stored(differences.join(near.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "of-hubs")
    # hubs whose members are of two components or more; their rows are dealt out
    some = of.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("hub")
    left = salted_join(of, some, "hub", F.col("class"))
    # of a pair, the member with the smaller difference: its partner's is at least as large, and if it is linked itself,
    # the partner is not (it is of another component), so that the partner's difference is over open_from
    partner = F.when(F.col("linked"), F.greatest("size", F.col("open_from"))).otherwise(F.col("size"))
    needed = F.greatest(F.ceil((partner + F.col("size") - F.col("h")) / 2), F.lit(1))
    head = F.slice("first", F.lit(1), F.greatest((F.col("size") - needed + 1).cast("int"), F.lit(0)))
    side = lambda x, elements: left.select(
        "hub", F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("size").alias(f"size_{x}"), F.col("component").alias(f"component_{x}"),
        F.posexplode(elements).alias(f"at_{x}", "e"),
    )
    n_a, n_b, size_a, size_b = (F.col(c) for c in ("n_a", "n_b", "size_a", "size_b"))
    # what both differences must share, and what they still can from the place of their first common element on
    overlap = (size_a + size_b - (n_a + n_b) * ratio) / 2 - 1e-6
    close = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent) & (size_a - F.col("at_a") >= overlap) & (size_b - F.col("at_b") >= overlap)
    ordered = (size_a < size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    pairs = (
        side("a", head).join(side("b", F.col("first")), ["hub", "e"]).where(close & ordered & (F.col("component_a") != F.col("component_b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "component_a", "component_b").distinct()
    )
    more = _verified(pairs, sets, percent)
    joined = components(more.select(F.least("component_a", "component_b").alias("a"), F.greatest("component_a", "component_b").alias("b")))
    drop_stored(met, star, sets, differences, of)
    whole = near.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left")
    whole = whole.select("node", F.coalesce("wider", "component").alias("component"))
    # a class without a link to a hub is a component of its own in `joined`
    return whole.unionByName(joined.join(near.select("node"), "node", "left_anti").select("node", "component"))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id).

    Documents are linked when 100 * intersection >= percent * union of their sets of 5-word shingles. A text without words
    (null, empty, blanks) has no shingles and no links. Rows of one doc_id are one document, repeated rows give repeated
    results; a row with a null id is reported with its shingles, no component and kept null. Other columns are not read.
    """
    r, m = plan_tables(percent)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(docs, r, m), "signed")
    found = linked_components(docs, signed, m, percent)
    classes = signed.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
    whole = classes.join(found, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("component"))
    out = signed.drop("halves").join(whole, ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but for those that another document of their group stands for. Rows with a
    null doc_id stay."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


#: All pairs that share a shingle, counted on full sets, and all that a document reaches.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS shingle FROM s),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(seen) AS component_id, n.doc_id = min(seen) AS kept FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n"""
