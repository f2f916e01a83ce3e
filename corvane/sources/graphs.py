"""Graphs from files: node-link JSON, code graphs in SQLite, and what kind a file is."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlite

SCHEMA = "nodes array<struct<id: string, label: string, norm_label: string, community: string, file_type: string>>, links array<struct<source: string, target: string>>"


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, links) of a node-link file; unknown fields go. A loop adds 2 to its node's degree."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    nodes, links = raw.select(F.inline("nodes")), raw.select(F.inline("links"))
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    label = F.coalesce(F.nullif("norm_label", F.lit("")), F.lower("label"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("norm_label", label), links


def count_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(n): the number of a node-link file's nodes; 0 if it can't be read as one."""
    raw = spark.read.schema("nodes array<string>").option("multiLine", True).json(path)
    return raw.agg(F.coalesce(F.sum(F.greatest(F.size("nodes"), F.lit(0))), F.lit(0)).cast("long").alias("n"))


class GraphCache:
    """Graphs by path and time of change: a file that was written anew is read anew, one that is as it was is not. A file that is gone is no graph."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def get(self, path: str) -> tuple[DataFrame, DataFrame] | None:
        known = self.held.get(path)
        try:
            mtime = os.stat(path).st_mtime_ns
        except FileNotFoundError:
            if known:
                self._drop(path)
            return None
        if known and known[0] == mtime:
            return known[1]
        if known:
            self._drop(path)
        graph = tuple(df.cache() for df in (code_graph(self.spark, path) if kind_of_file(path) == "code" else node_link(self.spark, path)))
        self.held[path] = mtime, graph
        return graph

    def _drop(self, path: str) -> None:
        for df in self.held.pop(path)[1]:
            df.unpersist()


def is_code_graph(path: str) -> bool:
    try:
        with sqlite.opened(path) as db:
            names = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
    except sqlite3.Error:
        return False
    return {"nodes", "edges"} <= names


def detect_code_graph(folder: str) -> str | None:
    """graph.db, graph.sqlite, or else the first other database with the tables of a code graph."""
    names = sorted(n for n in os.listdir(folder) if n.endswith((".db", ".sqlite")))
    for n in (*(x for x in ("graph.db", "graph.sqlite") if x in names), *names):
        if is_code_graph(f"{folder}/{n}"):
            return f"{folder}/{n}"
    return None


NODES = "kind string, name string, qualified_name string, file_path string, line_start long, line_end long, language string, is_test boolean"
EDGES = "kind string, source_qualified string, target_qualified string"


def code_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a code graph file on the driver, read by ranges of rows in all tasks; comparisons go to SQLite."""
    return sqlite.table(spark, path, "nodes", NODES).withColumn("is_test", F.coalesce("is_test", F.lit(False))), sqlite.table(spark, path, "edges", EDGES)


def kind_of_file(path: str, override: str | None = None) -> str:
    """graphify or code: as told, by the name's end, by what is in it, graphify if nothing tells."""
    if override:
        return override
    if path.endswith(".json"):
        return "graphify"
    return "code" if os.path.isfile(path) and is_code_graph(path) else "graphify"
