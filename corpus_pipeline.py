"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``; the last
says where the words of each document that is left were packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import exact_dedup, minhash_dedup, packing, quality, substring, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and so do frequent lines of the others; text and n_chars follow."""
    return quality.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id stays."""
    return minhash_dedup.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; text and n_chars follow."""
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document's words lie: doc_id, start, length, bin_id."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", repeats),
    ("best-fit packing", pack),
]

#: Tokenless similarity classes and greedy packing are beyond SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
