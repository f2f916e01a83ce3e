"""Graphs as they are given out: a repo's nodes and links, stars about a query, node-link files, what a viewer shows first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from ..functions.formats import KINDS, kind_of_path, rank_relevance
from ..session import cut

MODES = ("vector", "tags", "nodes", "auto")
#: The node that a star of results is about.
QUERY = "__query__"


def spec_nodes(specs: DataFrame, content: bool = False) -> DataFrame:
    """Specs as nodes: the label is the title or else the name."""
    label = F.coalesce(F.nullif("title", F.lit("")), "name")
    columns = [F.col("spec_id").alias("id"), label.alias("label"), F.lower(label).alias("norm_label"), "repo", "project", "path", "name", "title", "summary", "tags", F.col("ext").alias("file_type")]
    return specs.select(*columns, *(["content"] if content else []))


def repo_graph(specs: DataFrame, vectors: DataFrame, repo: str, mode: str = "auto", content: bool = False, typed: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a repo. Links are of near vectors (spec_id, vec), of shared tags or none; auto is vectors if the repo has any, else tags.

    typed, the links and further nodes of graphs.typed_links, is appended unless there are to be no links."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    own = specs.where(F.col("repo") == repo)
    nodes = spec_nodes(own, content)
    near = vectors.join(own.select("spec_id"), "spec_id", "left_semi").select(F.lit(repo).alias("block"), F.col("spec_id").alias("id"), "vec")
    if mode == "auto":
        near = cut(near)  # it is asked about first, and used then
        mode = "tags" if near.isEmpty() else "vector"
    if mode == "nodes":
        return nodes, nodes.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("weight")).limit(0)
    tied = graphs.near_links(near) if mode == "vector" else graphs.links_of_tags(own.select(F.col("repo").alias("block"), F.col("spec_id").alias("id"), "tags"))
    links = tied.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight")
    if typed:
        links = links.unionByName(typed[0], allowMissingColumns=True)
        nodes = nodes.unionByName(typed[1], allowMissingColumns=True)
    return nodes, links


def star(results: DataFrame, query: str = "your query") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a query in the middle and results (spec_id, label, path, place from 0) about it; places are a result list's, so few."""
    near = rank_relevance(F.col("place"))
    middle = results.sparkSession.createDataFrame([(QUERY, query, None, "query", 1.0)], "id string, label string, path string, kind string, relevance double")
    nodes = middle.union(results.select("spec_id", "label", "path", kind_of_path(F.col("path")), near))
    return nodes, results.select(F.lit(QUERY).alias("source"), F.col("spec_id").alias("target"), near.alias("weight"))


def with_sources(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """nodes (id, path, ...) with is_source: whether a source (spec_id, path, name, title) goes by the node's id or path."""
    keys = sources.select(F.explode(F.array("spec_id", "path", "name", "title")).alias("key")).where("key is not null and key <> ''").distinct()
    asked = nodes.select("id", F.explode(F.array("id", "path")).alias("key")).join(keys, "key", "left_semi").select("id").distinct()
    return nodes.join(asked.withColumn("is_source", F.lit(True)), "id", "left").withColumn("is_source", F.coalesce("is_source", F.lit(False)))


def kinds(nodes: DataFrame, kind: Column | None = None) -> DataFrame:
    """The kinds that nodes (path) have, in the legend's order: (kind, place)."""
    order = F.array(*map(F.lit, (*KINDS, "doc", "code", "query")))
    kind = kind_of_path(F.col("path")) if kind is None else kind
    return nodes.select(kind.alias("kind")).distinct().withColumn("place", F.array_position(order, F.col("kind")).cast("long")).orderBy("place")


def by_relevance(sources: DataFrame) -> DataFrame:
    """The most relevant first, those without a relevance last."""
    return sources.orderBy(F.desc_nulls_last("relevance"))


def picker(repos: DataFrame, selected: list[str]) -> DataFrame:
    """repos (repo, has_graph, n_specs) in the order of a picker: selected, with a graph, of more specs, by name."""
    return repos.withColumn("selected", F.col("repo").isin(selected)).orderBy(F.desc("selected"), F.desc("has_graph"), F.desc("n_specs"), "repo")


def node_link_lines(nodes: DataFrame, links: DataFrame, about: dict[str, str] | None = None) -> DataFrame:
    """(part, a, b, line): the lines of a node-link document, without commas, in order of part, a and b; one node or link a line, absent fields left out."""
    told = json.dumps(about or {}, sort_keys=True)
    frame = [(0, "", "", f'{{"directed":false,"multigraph":false,"graph":{told},"nodes":['), (2, "", "", '],"links":['), (4, "", "", "]}")]
    lines = nodes.sparkSession.createDataFrame(frame, "part int, a string, b string, line string")
    row = F.to_json(F.struct("*")).alias("line")
    lines = lines.union(nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("a"), F.lit("").alias("b"), row))
    return lines.union(links.select(F.lit(3).alias("part"), F.col("source").cast("string").alias("a"), F.col("target").cast("string").alias("b"), row))


def write_node_link(nodes: DataFrame, links: DataFrame, path: str, about: dict[str, str] | None = None) -> None:
    """A node-link document as a folder with one text file: being one JSON value it has one writer, which sorts on disk if it must."""

    def with_commas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            parts = batch.column(0).to_pylist()
            comma = [part == before and part in (1, 3) for before, part in zip([last, *parts], parts)]
            last = parts[-1] if parts else last
            yield pa.RecordBatch.from_arrays([pa.array([("," if c else "") + x for c, x in zip(comma, batch.column(1).to_pylist(), strict=True)], pa.string())], ["line"])

    lines = node_link_lines(nodes, links, about).repartition(1).sortWithinPartitions("part", "a", "b", "line")
    lines.select("part", "line").mapInArrow(with_commas, "line string").write.mode("overwrite").text(path)
