"""Spec rows: the adapter from driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import summary
from ..session import table


def specs_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents and labels as specs: repo is the source, project the language, tags the language and the labels."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    path = F.concat("lang", F.lit("/"), name, F.lit(".md"))
    tags = F.array_compact(F.array(F.col("lang"), F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return docs.join(labels, "doc_id", "left").select(
        F.concat("source", F.lit(":"), path).alias("spec_id"),
        F.col("source").alias("repo"),
        path.alias("path"),
        F.col("lang").alias("project"),
        name.alias("name"),
        name.alias("title"),
        tags.alias("tags"),
        summary(F.col("text")).alias("summary"),
        (F.lit(1704067200) + F.col("doc_id") * 3600).alias("modified_unix"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit("md").alias("ext"),
        F.col("text").alias("content"),
        "doc_id",
    )
