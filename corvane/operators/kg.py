"""Knowledge graph: declarations and typed edges resolved to entities, explained, summed up and exported."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import kind_of_id
from .render import json_text

EDGE = ("type", "src", "dst", "repo", "path", "field")


def _key() -> Column:
    return F.concat("repo", F.lit(":"), "path")


def resolve(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities (id, kind, repo, path, title, flags, provenance). The winner among declarations is the smallest "repo:path" as one string; more than one is a conflict. Endpoints that nothing declares are unresolved."""
    distinct = decls.dropDuplicates(["repo", "path", "id"])
    declared = distinct.groupBy("id").agg(F.min(F.struct(_key().alias("key"), "kind", "repo", "path", "title")).alias("w"), F.sort_array(F.collect_list(_key())).alias("provenance"), F.count("*").alias("n"))
    known = declared.select("id", "w.kind", "w.repo", "w.path", "w.title", F.when(F.col("n") > 1, "conflict").otherwise("").alias("flags"), "provenance")
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(distinct.select("id"), "id", "left_anti")
    empty = F.lit("")
    return known.union(missing.select("id", F.coalesce(kind_of_id(F.col("id")), empty), empty, empty, empty, F.lit("unresolved"), F.expr("cast(array() as array<string>)")))


def explain(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node, its outgoing edges and its incoming ones, in order."""
    order = [F.col(c) for c in EDGE]
    return nodes.where(F.col("id") == node_id), edges.where(F.col("src") == node_id).orderBy(*order), edges.where(F.col("dst") == node_id).orderBy(*order)


def explain_groups(edges: DataFrame, node_id: str) -> DataFrame:
    """(direction, type, edges): the edges of a node by direction and type."""
    out = edges.where(F.col("src") == node_id).withColumn("direction", F.lit("outgoing"))
    both = out.union(edges.where(F.col("dst") == node_id).withColumn("direction", F.lit("incoming")))
    return both.groupBy("direction", "type").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "repo", "path", "field"))).alias("edges"))


def explain_json(nodes: DataFrame, edges: DataFrame, node_id: str) -> dict:
    """The explanation as a document of schema version 1; node is None if there is none."""
    node, out, back = explain(nodes, edges, node_id)
    found = node.limit(1).collect()
    group = lambda df: {k: [r.asDict() for r in v] for k, v in _grouped(df.collect()).items()}
    return {"schema_version": 1, "node": found[0].asDict() if found else None, "outgoing": group(out), "incoming": group(back)}


def _grouped(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["type"], []).append(r)
    return out


def summary(decls: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each repo: structural and typed declarations, edges, conflicts and unresolved targets of edges."""
    counts = decls.groupBy("repo").agg(F.count_if(F.col("kind") == "file").alias("n_structural"), F.count_if(F.col("kind") != "file").alias("n_typed"))
    linked = edges.groupBy("repo").agg(F.count("*").alias("n_edges"))
    flags = nodes.select("id", "flags")
    conflicts = decls.join(flags.where("flags = 'conflict'"), "id").groupBy("repo").agg(F.count_distinct("id").alias("n_conflicts"))
    ends = edges.select("repo", F.col("dst").alias("id"))
    unresolved = ends.join(flags.where("flags = 'unresolved'"), "id").groupBy("repo").agg(F.count_distinct("id").alias("n_unresolved"))
    out = counts.join(linked, "repo", "full").join(conflicts, "repo", "left").join(unresolved, "repo", "left")
    return out.select("repo", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_structural", "n_typed", "n_edges", "n_conflicts", "n_unresolved")))


def unrecognized(rows: DataFrame, n: int = 5) -> DataFrame:
    """(repo, field, count): the n most frequent unrecognised fields of each repo; rows: repo, unrecognized array<string>."""
    from pyspark.sql import Window

    counted = rows.select("repo", F.explode("unrecognized").alias("field")).groupBy("repo", "field").count()
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("count"), "field"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def scan_summary(decls: DataFrame, edges: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """summary() with malformed, the paths of malformed specs in order, and fields, the most frequent unrecognised ones (field, count); empty lists where there are none. rows: repo, path, malformed, unrecognized."""
    top = unrecognized(rows).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "field"))).alias("t"))
    fields = top.select("repo", F.transform("t", lambda x: F.struct(x["field"].alias("field"), (-x["less"]).alias("count"))).alias("fields"))
    out = summary(decls, edges, nodes).join(malformed(rows).withColumnRenamed("paths", "malformed"), "repo", "left").join(fields, "repo", "left")
    return out.withColumns({"malformed": F.coalesce("malformed", F.expr("cast(array() as array<string>)")), "fields": F.coalesce("fields", F.expr("cast(array() as array<struct<field: string, count: bigint>>)"))})


def malformed(rows: DataFrame) -> DataFrame:
    """(repo, paths): the paths of each repo's specs whose frontmatter is malformed, in order; rows: repo, path, malformed."""
    return rows.where("malformed").groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): nodes by id, then edges by (src, type, dst, repo, path, field), as tab-separated lines in order."""
    line = lambda *c: F.concat_ws("\t", *c)
    own = nodes.select(F.lit(0).alias("part"), F.array("id").alias("order"), line(F.lit("node"), "id", "kind", "repo", "path", "title", "flags", json_text(F.col("provenance"))).alias("line"))
    links = edges.select(F.lit(1), F.array("src", "type", "dst", "repo", "path", "field"), line(F.lit("edge"), "src", "type", "dst", "repo", "path", "field"))
    return own.union(links).orderBy("part", "order").select("line")


def fingerprint(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """One row that changes if any declaration or edge does: counts and order-free sums of hashes, so resolving can be skipped."""
    h = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(1 << 40))).alias("s"))
    a, b = h(decls), h(edges)
    return a.select(F.struct("*").alias("decls")).crossJoin(b.select(F.struct("*").alias("edges"))).select(F.sha2(F.to_json(F.struct("decls", "edges")), 256).alias("fingerprint"))


def hash_tree(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(level, repo, folder, path, n, hash): of each path (level 3) what its declarations and edges come to, whatever their order, and of each folder (2), repo (1) and all (0) what the ones below come to. Kept beside the tables, it tells a later state's differences."""
    rows = lambda df, kind: df.select("repo", "path", F.xxhash64(F.lit(kind), *df.columns).alias("h"))
    each = rows(decls, "decl").union(rows(edges, "edge"))

    def over(df: DataFrame, *keys: str) -> DataFrame:
        # Two sums of unlike hashes of the rows' hashes: equal rows count as often as they stand there.
        sums = [F.sum(F.pmod(F.xxhash64(F.lit(k), "h"), F.lit(1 << 40))).alias(f"s{k}") for k in (0, 1)]
        return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums).select(*keys, "n", F.xxhash64("n", "s0", "s1").alias("h"))

    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    paths = over(each, "repo", "path").withColumn("folder", folder)
    own = lambda df, *keys: df.withColumn("h", F.xxhash64("h", *keys))
    folders = over(own(paths, "path"), "repo", "folder")
    repos = over(own(folders, "folder"), "repo")
    root = over(own(repos, "repo"))
    none = F.lit(None).cast("string")
    levels = [(3, paths, ("repo", "folder", "path")), (2, folders, ("repo", "folder")), (1, repos, ("repo",)), (0, root, ())]
    parts = [df.select(F.lit(k).alias("level"), *(F.col(c) if c in keys else none.alias(c) for c in ("repo", "folder", "path")), "n", F.col("h").alias("hash")) for k, df, keys in levels]
    return functools.reduce(DataFrame.union, parts)


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, what) of two hash_tree() tables: paths that were added, removed or changed. Levels are gone down from the top: folders are compared in unlike repos alone, and paths in unlike folders alone."""

    def unlike(level: int, keys: list[str], within: DataFrame | None, above: list[str]) -> DataFrame:
        one, two = (df.where(F.col("level") == level).select(*keys, F.col("hash").alias(name)) for df, name in ((before, "was"), (after, "now")))
        if within is not None:
            one, two = (df.join(within, above, "left_semi") for df in (one, two))
        return one.join(two, keys, "full").where(~F.col("was").eqNullSafe(F.col("now")))

    repos = unlike(1, ["repo"], None, []).select("repo")
    folders = unlike(2, ["repo", "folder"], repos, ["repo"]).select("repo", "folder")
    paths = unlike(3, ["repo", "folder", "path"], folders, ["repo", "folder"])
    return paths.select("repo", "path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("what"))
