"""A corpus pipeline of five stages: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, near_duplicates, packing, quality, substrings
from corvane.llm.common import delete, gathered, shared_folder, table
from corvane.llm.tokens import vocabulary


def in_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out in no more partitions than the files of docs are read in, but for all cores at once: each makes a file of a stage's table, and a shuffle's partitions may be many and nearly empty."""
    return gathered(out, docs.rdd.getNumPartitions(), 1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.filter(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return in_files(near_duplicates.keep_one(docs), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of smaller doc_id are cut out; documents that had text and have none left go."""
    return substrings.cut_out(docs).where("text is null or text <> '' or n_chars is null")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return in_files(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences."""
    return in_files(packing.pack(docs, vocabulary("word_bpe_49k.json")), docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicate_join), ("suffixes", suffix_dedup), ("benchmark", decontamination), ("packing", packed)]
#: SQL expresses neither expectation-maximisation nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; between them, tables in the shared folder, each deleted when the next one stands."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
