"""Results for people and for programs: lines of text and JSON documents, made of rows as they come from queries."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats


def as_json(value: object) -> str:
    """A value as an indented document, as the encoder of the files' readers writes it: signs of markup are escaped."""
    return json.dumps(value, indent=2, ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n"


def json_text(value: Column) -> Column:
    """A struct, array or map as JSON in one line, with signs of markup escaped."""
    out = F.to_json(value)
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def rows_as_json(rows: DataFrame) -> str:
    """The rows of a result list as a document; no rows are null."""
    found = [r.asDict(recursive=True) for r in rows.toLocalIterator()]
    return as_json(found or None)


def write_json(path: str, value: object) -> None:
    Path(path).write_text(as_json(value), encoding="utf-8")


def served(path: str) -> str:
    """A graph's file as it stands; an empty graph if there is none."""
    file = Path(path)
    return file.read_text(encoding="utf-8") if file.exists() else as_json({"nodes": [], "links": []})


def hits(rows: DataFrame) -> DataFrame:
    """(place, line): two lines for each hit (repo, path, title, tags, ext), in order of its place."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("  ("), F.array_join("tags", ", "), F.lit(")"))).otherwise("")
    first = F.concat(F.lit("  ["), "repo", F.lit("] "), "path")
    second = F.concat(F.lit("    "), "title", tags, F.lit("  ."), "ext")
    return rows.select("place", F.posexplode(F.array(first, second)).alias("part", "line")).select((2 * F.col("place") + F.col("part")).alias("place"), "line").orderBy("place")


def listing(rows: Iterable) -> Iterator[str]:
    """Lines of specs (repo, project, name, title, ext) in order: a heading for each repo and each of its projects."""
    repo = project = None
    for r in rows:
        if r["repo"] != repo:
            repo, project = r["repo"], None
            yield f"[{repo}]"
        if r["project"] != project:
            project = r["project"]
            yield f"  {project}/"
        yield f"    {r['name']}  {r['title']}  .{r['ext']}"
    if repo is None:
        yield "No specs found."


def stats(row: dict, last_scan: str | None = None) -> list[str]:
    """Lines of the catalog's numbers."""
    told = {"Repos": row["n_repos"], "Specs": row["n_specs"], "Projects": row["n_projects"], "Tags": row["n_tags"], "Bytes": row["n_bytes"], "Last scan": last_scan or "never"}
    return [f"{name + ':':<12} {value}" for name, value in told.items()]


def repos(rows: DataFrame, now: int) -> DataFrame:
    """(repo, line) of registered repos (repo, path, n_specs, commit, scanned_unix): size, age and commit in columns."""
    age = formats.human_age(F.lit(now) - F.col("scanned_unix"))
    line = F.concat_ws("  ", F.rpad("repo", 22, " "), F.lpad(F.col("n_specs").cast("string"), 6, " "), F.rpad(F.when(F.col("scanned_unix") > 0, age).otherwise("—"), 6, " "), formats.short_commit(F.col("commit")), "path")
    return rows.select("repo", line.alias("line")).orderBy("repo")


def found(rows: DataFrame) -> DataFrame:
    """(place, line): a table of what find() gives (type, repo, name, score, and path if it has one)."""
    line = F.format_string("%-6.2f  %-10s  %-22s  %-50s  %s", F.col("score"), F.col("type"), F.col("repo"), formats.truncated(F.col("name"), 50), F.col("path") if "path" in rows.columns else F.lit(""))
    return rows.select(F.struct((-F.col("score")).alias("s"), "type", "repo", "name").alias("place"), line.alias("line")).orderBy("place").select("line")


def explanation(node: dict | None, outgoing: dict[str, list[dict]], incoming: dict[str, list[dict]]) -> list[str]:
    """Lines of an explained node: what it is and its edges by type."""
    if node is None:
        return ["No such node."]
    out = [f"{node['id']}  ({node['kind'] or 'unknown'})", f"  {node['title'] or '-'}  {node['repo']}:{node['path']}" if node["repo"] else "  declared nowhere"]
    if node["flags"]:
        out.append(f"  {node['flags']}: {', '.join(node['provenance']) or '-'}")
    for name, groups, end in (("outgoing", outgoing, "dst"), ("incoming", incoming, "src")):
        for kind in sorted(groups):
            out.append(f"  {name} {kind}")
            out += [f"    {e[end]}  {e['repo']}:{e['path']} ({e['field']})" for e in groups[kind]]
    return out
