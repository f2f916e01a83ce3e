"""Texts as vectors, end to end: specs' embeddings, an index of them by bucket, searches by a query's text, and the graphs about it.

An embedding has 256 buckets, most of them 0 in a short text, so it is kept as its weights. The index has them in order of bucket: a query
of a few words has a few buckets, and reads the weights of these alone. Whole vectors are made only for the specs that a graph
has as nodes."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import DIMENSION, FNV_PRIME, FNV_START, hashed_weights
from . import fts, graphs, rank

#: Runs of letters and decimal digits of the text in lower case.
TOKEN = r"[\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def text_of(specs: DataFrame) -> Column:
    """What of a spec is embedded."""
    return F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary", "content") if c in specs.columns))


def embedded(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, bucket, weight) of each row's text; none of a text without tokens."""
    return hashed_weights(rows.select(key, tokens(text).alias("tokens")), key, "tokens")


def query_weights(text: str) -> dict[int, float]:
    """The same on the driver, for queries; empty if there is no token."""
    out: dict[int, float] = {}
    inside = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in text.lower())
    for token in re.split(" +", inside.strip()) if inside.strip() else []:
        h = FNV_START
        for b in token.encode():
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
        out[h % DIMENSION] = out.get(h % DIMENSION, 0.0) + (1 if h >> 16 & 1 else -1)
    length = math.sqrt(sum(x * x for x in out.values()))
    return {k: x / length for k, x in out.items() if x}


@dataclass
class Vectors:
    """weights (bucket, spec_id, weight), in order of bucket where they come from save()."""

    weights: DataFrame

    def cosines(self, query: dict[int, float], among: DataFrame | None = None) -> DataFrame:
        """(spec_id, cosine) of all specs that have a bucket of the query, or of those among (spec_id) that have a vector."""
        own = self.weights if among is None else self.weights.join(among.select("spec_id").distinct(), "spec_id", "left_semi")
        weight = F.element_at(F.create_map(*(F.lit(x) for k, w in sorted(query.items()) for x in (k, w))), F.col("bucket")) if query else F.lit(0.0)
        if among is None:
            own = own.where(F.col("bucket").isin(sorted(query)) if query else F.lit(False))
        return own.groupBy("spec_id").agg(F.sum(F.col("weight") * F.coalesce(weight, F.lit(0.0))).alias("cosine"))

    def whole(self, among: DataFrame) -> DataFrame:
        """(spec_id, vec) of those among (spec_id) that have a vector."""
        own = self.weights.join(among.select("spec_id").distinct(), "spec_id", "left_semi")
        of = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))  # 256 entries at most
        zeros = F.transform(F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda b: F.coalesce(F.element_at(F.col("of"), b), F.lit(0.0)))
        return own.groupBy("spec_id").agg(of.alias("of")).select("spec_id", zeros.alias("vec"))


def index(specs: DataFrame) -> Vectors:
    return Vectors(embedded(specs, "spec_id", text_of(specs)).select(F.col("bucket"), "spec_id", "weight"))


def save(vectors: Vectors, path: str) -> None:
    vectors.weights.repartitionByRange("bucket", "spec_id").sortWithinPartitions("bucket", "spec_id").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Vectors:
    return Vectors(spark.read.parquet(path))


def updated(vectors: Vectors, changed: DataFrame, deleted: DataFrame) -> Vectors:
    """The vectors after specs were changed or added (rows of specs) and others deleted (spec_id)."""
    gone = changed.select("spec_id").union(deleted.select("spec_id")).distinct()
    return Vectors(vectors.weights.join(gone, "spec_id", "left_anti").select("bucket", "spec_id", "weight").unionByName(index(changed).weights))


def hybrid(idx, vectors: Vectors, specs: DataFrame, query: str, repo: str | None = None, directory: str | None = None, k: int = 50) -> DataFrame:
    """The best hits of a search (fields of fts.HIT) whose places by words are fused with those by cosine to the query's text, with score, best first. Candidates are those of the search in its scope, at most rank.CANDIDATES; those without a vector count by words alone. A query without tokens has no vector: its hits stay in the order of words, and score is their rank."""
    hits = fts.search_specs(idx, specs, query, None if repo is None else [repo], directory, rank.CANDIDATES)
    own = query_weights(query)
    if not own:
        return hits.withColumn("score", F.col("rank")).limit(k)
    hits = fts.cut(hits)  # CANDIDATES rows at most, read for their ranks, their cosines and their fields
    fused = rank.rrf(hits.select("spec_id", "rank"), vectors.cosines(own, hits), k)
    place = F.row_number().over(Window.orderBy("rank", "spec_id"))
    return hits.withColumn("place", place).join(fused, "spec_id").orderBy(F.desc("score"), "place").drop("place")


def nearest(vectors: Vectors, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """(spec_id, cosine) of the k specs nearest to the query's text, best first; none for a query without tokens. Specs that have no bucket of the query are at 0."""
    own = query_weights(query)
    if not own:
        return vectors.cosines({}).limit(0)
    weights = vectors.weights if among is None else vectors.weights.join(among.select("spec_id").distinct(), "spec_id", "left_semi")
    found = Vectors(weights).cosines(own)
    if found.where("cosine > 0").limit(k).count() < k:  # then those of no common bucket, and those below 0, make up the number
        found = weights.select("spec_id").distinct().join(found, "spec_id", "left").select("spec_id", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    return found.orderBy(F.desc("cosine"), "spec_id").limit(k)


def ego(vectors: Vectors, specs: DataFrame, query: str, repo: str | None = None, seeds: int = 10, k: int = graphs.CAP, least: float = graphs.LEAST) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) about the query's text, over the specs of a repo or of all: graphs.ego() of its embedding. No nodes for a query without tokens."""
    scope = specs if repo is None else specs.where(F.col("repo") == repo)
    all_ = vectors.whole(scope).withColumnRenamed("spec_id", "id")
    own = query_weights(query)
    asked = specs.sparkSession.createDataFrame([(None if not own else "", [own.get(b, 0.0) for b in range(DIMENSION)])], "query string, qvec array<double>").where("query is not null")
    return graphs.ego(asked, all_, seeds, k, least)


def linked(vectors: Vectors, specs: DataFrame, least: float = graphs.LEAST, cap: int = graphs.CAP) -> DataFrame:
    """(block, a, b, weight): near specs of each repo, linked with cap links a spec at most."""
    own = specs.select("spec_id", F.col("repo").alias("block"))
    return graphs.near_links(vectors.whole(own).join(own, "spec_id").select("block", F.col("spec_id").alias("id"), "vec"), least, cap)
