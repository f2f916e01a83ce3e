"""Catalog queries over specs: lists, facets, counts, look-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import in_directory
from ..functions.text import small, tokens_of
from .fts import Index, Node, Phrase, search


def projects(specs: DataFrame) -> DataFrame:
    return specs.groupBy("repo", "project").agg(F.count("*").alias("n_specs"))


def tags(specs: DataFrame) -> DataFrame:
    return specs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_specs"))


def stats(specs: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """One row: repos, specs, projects, tags, bytes, always live; and with a store's meta the time of its last scan, or never."""
    tagged = specs.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("n_tags"))
    rest = specs.agg(F.count_distinct("repo").alias("n_repos"), F.count("*").alias("n_specs"), F.count_distinct("project").alias("n_projects"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
    out = rest.crossJoin(tagged)  # one row each
    return out if meta is None else out.withColumn("last_scan", F.lit(meta.get("last_scan", "never")))


def repos(registry: DataFrame, specs: DataFrame) -> DataFrame:
    """Registered repos (repo, ...) with their numbers of specs, 0 if they have none."""
    return registry.join(specs.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").select(*registry.columns, F.coalesce("n", F.lit(0)).alias("n_specs"))


def listing(specs: DataFrame, name: str | None = None) -> DataFrame:
    """All specs, or those of the repo of that name, or else of the project: a repo's name goes before a project's."""
    if name is None:
        return specs.orderBy("repo", "project", "name", "path")
    if not specs.where(F.col("repo") == name).isEmpty():
        return specs.where(F.col("repo") == name).orderBy("project", "name", "path")
    return specs.where(F.col("project") == name).orderBy("repo", "name", "path")


def recent(specs: DataFrame, n: int = 10) -> DataFrame:
    return specs.orderBy(F.desc("modified_unix"), "repo", "path").limit(n if n > 0 else 10)


def by_tag(specs: DataFrame, tag: str) -> DataFrame:
    return specs.where(F.exists("tags", lambda t: small(t) == small(tag))).orderBy("repo", "name", "path")


def read(specs: DataFrame, name: str, repo: str | None = None, directory: str | None = None) -> DataFrame:
    """The specs of that name, whatever the case of its A-Z: none is an error for the caller, one is the answer, more are ambiguous."""
    found = specs.where(small(F.col("name")) == small(name))
    if repo:
        found = found.where(F.col("repo") == repo)
    if directory:
        found = found.where(in_directory(F.col("path"), directory))
    return found.orderBy("repo", "path")


def excluding(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows whose path holds none of the patterns."""
    for p in patterns:
        rows = rows.where(~F.contains("path", F.lit(p)))
    return rows


def looked_up(specs: DataFrame, name: str, repo: str | None = None, directory: str | None = None) -> DataFrame:
    """What reading a spec by its name comes to: all specs of that name, in order, with outcome "one" or "many"; no row if there is none."""
    fields = [c for c in ("spec_id", "repo", "project", "name", "path") if c in specs.columns]
    found = read(specs, name, repo, directory).select(*fields)
    told = found.limit(2).agg(F.when(F.count("*") > 1, "many").otherwise("one").alias("outcome"))  # one row
    return found.join(F.broadcast(told)).orderBy("repo", "path")


def legacy_names(specs: DataFrame, text: str) -> DataFrame:
    """Specs whose name holds the text as LIKE has it, in order of repo and name."""
    return specs.where(F.like(small(F.col("name")), F.lit("%" + small(text).replace("\\", "\\\\") + "%"))).orderBy("repo", "name", "path")


def legacy_related(specs: DataFrame, idx: Index, name: str, n: int = 10) -> DataFrame:
    """(spec_id, repo, path, project, name, rank): specs that have any of the words of title and tags, cut to ASCII letters and digits, of the first spec whose name holds the text; those of its name are left out. A word that comes twice counts twice."""
    first = legacy_names(specs, name).select("name", "title", "tags").limit(1).collect()
    if not first:
        raise LookupError(f"no spec has {name!r} in its name")
    words = re.findall("[a-z0-9]+", small(" ".join([first[0]["title"] or "", *(first[0]["tags"] or [])])))
    parts = [Phrase([w]) for w in words]
    query = None if not parts else Node("OR", parts) if len(parts) > 1 else parts[0]
    found = search(idx, "" if query is None else query).join(specs.select("spec_id", "repo", "path", "project", "name"), "spec_id")
    return found.where(F.col("name") != first[0]["name"]).orderBy("rank", "repo", "path").limit(n)


def related_query(name: str, title: str, own_tags: list[str]) -> Node | Phrase | None:
    """Any of the tags and title words of more than three bytes, but none that is the name; a term that comes twice counts twice."""
    words = [w.strip("\"':.,!?") for w in title.split()]
    terms = [t for t in own_tags if t.strip()] + [w for w in words if len(w.encode()) > 3]
    parts = [Phrase(tokens_of(t)) for t in terms if t.strip().lower() != name.lower()]
    return None if not parts else Node("OR", parts) if len(parts) > 1 else parts[0]


def related(specs: DataFrame, idx: Index, name: str, n: int | None = 10) -> DataFrame:
    """(spec_id, repo, path, project, name, rank): the specs nearest by tags and title words to the first of that name, which are left out. A name that no spec has is a LookupError."""
    first = specs.where(small(F.col("name")) == small(name)).orderBy("repo", "path").select("name", "title", "tags").limit(1).collect()
    if not first:
        raise LookupError(f"no spec is named {name!r}")
    query = related_query(name, first[0]["title"] or "", list(first[0]["tags"] or []))
    found = search(idx, "" if query is None else query).join(specs.select("spec_id", "repo", "path", "project", "name"), "spec_id")
    ordered = found.where(small(F.col("name")) != small(name)).orderBy("rank", "repo", "path")
    return ordered if n is None else ordered.limit(n)


def shadowed(names: list[str], removed: list[str]) -> list[str]:
    """names without those removed, in order."""
    gone = {n.strip() for n in removed}
    return [n for n in names if n not in gone]


def unknown(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """entries (name) that are not among the valid ones (name)."""
    return entries.join(valid.select("name").distinct(), "name", "left_anti")


def names_by_tag(specs: DataFrame) -> DataFrame:
    """(tag, names): the names of each tag's specs as one text, in order; as long as the tag's names are."""
    return specs.select(F.explode("tags").alias("tag"), "name").groupBy("tag").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def extension_facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ext").agg(F.count("*").alias("n"))


def top_tags(rows: DataFrame, n: int = 10) -> DataFrame:
    return tags(rows).orderBy(F.desc("n_specs"), "tag").limit(n)


def facets(nodes: DataFrame, types=(), repos=(), projects=(), tags=(), text: str = "") -> DataFrame:
    """Nodes that pass all active facets; within one, any value will do."""
    out = nodes
    for column, values in (("kind", types), ("repo", repos), ("project", projects)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if text:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("title"), F.lit(text.lower())))
    return out
