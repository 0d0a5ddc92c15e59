"""Toxicity filter, near-duplicate removal, benchmark decontamination and packing, each over all that the last one kept.

All stages but the last keep the columns of documents, extra ones too. Rows with a null doc_id stay (they have no label and are
copies of nothing) unless the classifier or an item rejects their text; null and empty texts are empty texts and stay;
rows of one doc_id stay or go together as near duplicates; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunfleet.llm.decontamination import decontaminated
from sunfleet.llm.neardup import without_near_duplicates
from sunfleet.llm.packing import pack_documents
from sunfleet.llm.shared import stored
from sunfleet.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on labelled ones, doesn't reject."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (a similarity of 0.8 or more)."""
    return without_near_duplicates(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning, tokenizing and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
