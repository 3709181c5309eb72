"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the cluster's shared
folder and reads it again as the next stage's docs. A table that the next stage has read is deleted, but for the last.

All stages but the last return the columns of their input as they are, whatever they are called, and an empty table for
an empty one; they read texts of any length whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import bagminhash, cuckoo, fertility, mixing, packing
from lodestream.llm.common import removed, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep. Null, empty and short texts go; repeated rows are judged alike."""
    return fertility.filtered(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id (null: smallest); of rows equal in both, one. A null text equals the empty one."""
    return cuckoo.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the row with the least doc_id. Texts without words and rows without a doc_id stay."""
    return bagminhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard in shuffled order. A null source is a source, the last one."""
    return mixing.drawn(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their place in sequences. A null or empty text is a piece of its end id; repeated rows are packed each."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
