"""Retrieval over several sources at once: specs, graphs of documents, code graphs; what is missing is told."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scope import GRAPH, kept, partition
from ..session import cut
from . import codegraph, fts, rank

MISSING = "repo string, reason string, fix string"


@dataclass
class Sources:
    """What there is to search: an index and its specs; graph nodes (repo, id, label, norm_label, degree); code nodes (graph, qualified_name, name, ...) and code edges (graph, kind, source_qualified, target_qualified), where graph is a repo's name or graph:<name>.

    with_graph and with_code are the repos and external graphs that should have one; unreadable are those whose file could not be read."""

    index: fts.Index
    specs: DataFrame
    graphs: DataFrame | None = None
    code_nodes: DataFrame | None = None
    code_edges: DataFrame | None = None
    registered: list[str] = field(default_factory=list)
    with_graph: list[str] = field(default_factory=list)
    with_code: list[str] = field(default_factory=list)
    unreadable: list[str] = field(default_factory=list)


def code_hits(nodes: DataFrame, edges: DataFrame, query: str, each: int) -> DataFrame:
    """The first nodes of each graph that hold the query, as codegraph.find orders them, with their out-degrees."""
    held = codegraph.held(nodes, query)
    place = F.row_number().over(Window.partitionBy("graph").orderBy("place", F.length("qualified_name"), "qualified_name"))
    found = held.withColumn("n", place).where(F.col("n") <= each).drop("n")
    counted = edges.groupBy("graph", F.col("source_qualified").alias("qualified_name")).agg(F.count("*").alias("degree"))
    return found.join(counted, ["graph", "qualified_name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def missing(sources: Sources, repos: list[str], graphs: list[str]) -> list[tuple[str, str, str]]:
    """(repo, reason, fix) of each source in scope that should be there and cannot be read."""
    lost = set(sources.unreadable)
    out = [(r, "document graph unreadable", f"make the graph of {r} anew") for r in repos if r in sources.with_graph and r in lost]
    return out + [(r, "code graph unreadable", f"make the code graph of {r} anew") for r in [*repos, *(GRAPH + g for g in graphs)] if r in sources.with_code and r in lost]


def find(sources: Sources, query: str, scope: list[str], weights: dict | None = None, limits: dict | None = None, limit: int | None = rank.FOUND) -> tuple[DataFrame, DataFrame]:
    """(results, missing): results (type, repo, name, score) of the three sources, each cut to its own limit, brought to 0..1, weighted, and in one order; repos of the scope that are not registered are left out."""
    weights, limits = rank.WEIGHTS | (weights or {}), rank.LIMITS | (limits or {})
    repos, graphs = partition(scope)
    chosen = kept(repos, sources.registered)
    spark = sources.specs.sparkSession
    none = spark.createDataFrame([], "repo string, name string, score double")
    hits = fts.search_specs(sources.index, sources.specs, query, repos, limit=limits["specs"])
    specs = hits.select("repo", "name", (-F.col("rank")).alias("score"))
    graph = code = none
    if sources.graphs is not None:
        own = sources.graphs.where(F.col("repo").isin(chosen))
        graph = rank.label_hits(own, query, limits["graph"]).select("repo", F.col("label").alias("name"), F.log1p(F.col("degree").cast("double")).alias("score"))
    if sources.code_nodes is not None and sources.code_edges is not None:
        own = F.col("graph").isin([*chosen, *(GRAPH + g for g in graphs)])
        found = code_hits(sources.code_nodes.where(own), sources.code_edges.where(own), query, limits["code"])
        bonus = rank.name_bonus(F.col("qualified_name"), F.col("name"), query)
        code = found.select(F.col("graph").alias("repo"), F.col("qualified_name").alias("name"), (F.log1p(F.col("degree").cast("double")) + bonus).alias("score"))
    told = spark.createDataFrame(missing(sources, chosen, graphs), MISSING)
    return rank.find(specs, graph, code, weights, limit), told


def context(sources: Sources, query: str, scope: list[str], hops: int = codegraph.HOPS, cap: int = codegraph.BLAST, **how) -> tuple[DataFrame, DataFrame]:
    """find() with the blast radius of the first code hit as an array on its row."""
    found, told = find(sources, query, scope, **how)
    found = cut(found)  # a result list
    first = found.where("type = 'code'").orderBy(F.desc("score"), "repo", "name").limit(1).collect()
    empty = F.expr("cast(null as array<struct<hop: int, qualified_name: string>>)")
    if not first or sources.code_nodes is None or sources.code_edges is None:
        return found.withColumn("blast", empty), told
    own = F.col("graph") == first[0]["repo"]
    around, _ = codegraph.blast_radius(sources.code_nodes.where(own), sources.code_edges.where(own), first[0]["name"], hops, cap)
    return rank.context(found, around), told


def semantic(sources: Sources, cosine: DataFrame, query: str, repos: list[str] | None = None, k: int = 50) -> DataFrame:
    """(spec_id, repo, score) of a search whose hits are fused with the cosines (spec_id, cosine) of those that have a vector, best first: of all specs, or the k of each repo merged."""
    if repos is None:
        hits = fts.search_specs(sources.index, sources.specs, query, limit=rank.CANDIDATES)
        fused = rank.rrf(hits.select("spec_id", "rank"), cosine, k).join(sources.specs.select("spec_id", "repo"), "spec_id")
    else:
        own = sources.specs.where(F.col("repo").isin(repos) if repos else F.lit(False)).select("spec_id", "repo")
        fused = rank.rrf_by_repo(fts.search(sources.index, query).join(own, "spec_id"), cosine, k)
    return fused.select("spec_id", "repo", "score").orderBy(F.desc("score"), "repo", "spec_id")


def by_repo(sources: Sources, query: str, repos: list[str], each: int = rank.CANDIDATES) -> DataFrame:
    """Hits of a plain search of some repos, each repo's best first, in the order of repos: one plan for all of them."""
    fields = [c for c in fts.HIT if c in sources.specs.columns]
    hits = fts.search(sources.index, query).join(sources.specs.where(F.col("repo").isin(repos)).select(*fields), "spec_id")
    return rank.per_repo(hits, repos, each)
