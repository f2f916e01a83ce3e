"""Ranks: reciprocal rank fusion, centrality, min-max, three-source fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF, CANDIDATES = 60, 200
WEIGHTS, LIMITS, FOUND = {"specs": 1.0, "graph": 0.7, "code": 0.8}, {"specs": 20, "graph": 10, "code": 10}, 30


def rrf(hits: DataFrame, cosine: DataFrame, k: int = 50) -> DataFrame:
    """(spec_id, score) of hits (spec_id, rank) fused with cosine (spec_id, cosine) of those that have a vector. Only the candidates are ranked by cosine."""
    top = hits.orderBy("rank", "spec_id").limit(CANDIDATES)
    placed = top.withColumn("i", F.row_number().over(Window.orderBy("rank", "spec_id")) - 1)  # CANDIDATES rows
    near = placed.join(cosine, "spec_id").withColumn("j", F.row_number().over(Window.orderBy(F.desc("cosine"), "i")) - 1).select("spec_id", "j")
    score = 1.0 / (RRF + F.col("i")) + F.coalesce(1.0 / (RRF + F.col("j")), F.lit(0.0))
    return placed.join(near, "spec_id", "left").select("spec_id", score.alias("score"), "i").orderBy(F.desc("score"), "i").limit(k).select("spec_id", "score")


def rrf_by_repo(hits: DataFrame, cosine: DataFrame, k: int = 50) -> DataFrame:
    """(spec_id, repo, score): rrf() of each repo's hits (spec_id, repo, rank) by itself, the k of each, in one plan."""
    order = lambda *c: Window.partitionBy("repo").orderBy(*c)
    placed = hits.select("spec_id", "repo", "rank").withColumn("i", F.row_number().over(order("rank", "spec_id")) - 1).where(F.col("i") < CANDIDATES)
    near = placed.join(cosine, "spec_id").withColumn("j", F.row_number().over(order(F.desc("cosine"), "i")) - 1).select("spec_id", "j")
    score = 1.0 / (RRF + F.col("i")) + F.coalesce(1.0 / (RRF + F.col("j")), F.lit(0.0))
    fused = placed.join(near, "spec_id", "left").withColumn("score", score)
    return fused.withColumn("place", F.row_number().over(order(F.desc("score"), "i"))).where(F.col("place") <= k).select("spec_id", "repo", "score")


def boost(degree: Column) -> Column:
    return F.least(F.lit(1.5), 1 + F.log1p(degree.cast("double")) / 8)


def graph_aware(hits: DataFrame, degrees: DataFrame) -> DataFrame:
    """hits (repo, name, rank, ...) with ranks moved by the largest degree of the label that is the name in the same repo's graph; degrees: repo, label, degree."""
    most = degrees.groupBy("repo", F.lower("label").alias("low")).agg(F.max("degree").alias("degree"))
    met = hits.withColumn("low", F.lower("name")).join(most, ["repo", "low"], "left")
    up = boost(F.coalesce("degree", F.lit(0)))
    return met.withColumn("rank", F.when(F.col("rank") < 0, F.col("rank") * up).otherwise(F.col("rank") / up)).drop("low", "degree")


def min_max(rows: DataFrame, score: str) -> DataFrame:
    """score brought to 0..1; one value, or equal ones, are 1. The two ends come as one row."""
    ends = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    value = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(score) - F.col("_lo")) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return rows.crossJoin(F.broadcast(ends)).withColumn(score, value).drop("_lo", "_hi")


def name_bonus(qualified: Column, name: Column, query: str) -> Column:
    q = query.lower()
    return F.when(F.lower(name) == q, 0.5).when(F.endswith(F.lower(qualified), F.lit("." + q)), 0.25).otherwise(0.0)


def label_hits(nodes: DataFrame, query: str, each: int) -> DataFrame:
    """nodes (repo, id, label, degree): those whose label holds the query, the each of highest degree of each repo."""
    held = nodes.where(F.contains(F.lower("label"), F.lit(query.lower())))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("degree"), "id"))
    return held.withColumn("place", place).where(F.col("place") <= each).drop("place")


def find(specs: DataFrame, graph: DataFrame, code: DataFrame, weights: dict = WEIGHTS, limit: int | None = FOUND) -> DataFrame:
    """(type, repo, name, score) of three sources with raw scores (repo, name, score): each brought to 0..1, weighted, and all in one order."""
    out = None
    for kind, rows in (("specs", specs), ("graph", graph), ("code", code)):
        own = min_max(rows.select("repo", "name", "score"), "score").select(F.lit(kind).alias("type"), "repo", "name", (F.col("score") * weights[kind]).alias("score"))
        out = own if out is None else out.unionByName(own)
    ordered = out.orderBy(F.desc("score"), "type", "repo", "name")
    return ordered if limit is None else ordered.limit(limit)


def context(found: DataFrame, blast: DataFrame) -> DataFrame:
    """found with the blast radius (qualified_name, hop) of its first code hit, as an array on that row alone."""
    first = found.where("type = 'code'").orderBy(F.desc("score"), "repo", "name").limit(1).select("type", "repo", "name")
    around = blast.agg(F.sort_array(F.collect_list(F.struct("hop", "qualified_name"))).alias("blast"))  # as many as the radius's cap
    return found.join(F.broadcast(first.crossJoin(around)), ["type", "repo", "name"], "left")


def per_repo(hits: DataFrame, repos: list[str], each: int = CANDIDATES) -> DataFrame:
    """hits (repo, rank, ...) in the order of repos, each's best first and at most each."""
    place = F.row_number().over(Window.partitionBy("repo").orderBy("rank", "spec_id"))
    order = F.array_position(F.array(*map(F.lit, repos)), F.col("repo"))
    return hits.where(F.col("repo").isin(*repos)).withColumn("place", place).where(F.col("place") <= each).withColumn("order", order).orderBy("order", "place").drop("order", "place")
