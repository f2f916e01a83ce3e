"""What is read from a document's text: titles, frontmatter, tags, references, summaries, identities, typed edges."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import small

# White space of the patterns, the frontmatter fields and their edge types, id kinds, plain fields.
S = r"[\t\n\f\r ]"
EDGES = {"relationships": "related_to", "implementedBy": "implements", "upstream": "upstream", "dependsOn": "depends_on", "components": "has_component", "from-discovery": "from_discovery"}
REVERSED = ("implementedBy",)
PLAIN_FIELDS = ("id", "tags", "title", "summary")
CANONICAL = r"^(component|req|capability|context)://[^\t\n\f\r ]+$"
SUMMARY_POINTS = 300


def frontmatter_block(content: Column) -> Column:
    """The whole block from the first --- line to the next, empty if there is none."""
    return F.regexp_extract(content, rf"(?s)\A---{S}*\n(.*?)\n---{S}*\n", 0)


def frontmatter_raw(content: Column) -> Column:
    return F.regexp_extract(content, rf"(?s)\A---{S}*\n(.*?)\n---{S}*\n", 1)


def body(content: Column) -> Column:
    return F.substr(content, F.length(frontmatter_block(content)) + 1)


def project(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(F.lit("_root"))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def in_directory(path: Column, directory: str) -> Column:
    """path under the directory as LIKE has it: the case of A-Z is ignored, % and _ stay wildcards."""
    return F.like(small(path), F.lit(small(directory).replace("\\", "\\\\") + "%"))


def title(content: Column, name: Column) -> Column:
    """The first first-level heading anywhere, else the name."""
    found = F.trim(F.regexp_replace(F.regexp_extract(content, rf"(?md)^#{S}+(.+)", 1), rf"^{S}+|{S}+$", ""))
    return F.coalesce(F.nullif(found, F.lit("")), name)


def raw_tags(content: Column) -> Column:
    """The first tags line of the frontmatter, as it stands."""
    return F.regexp_replace(F.regexp_extract(frontmatter_raw(content), rf"(?imd)^tags:{S}*(.+)", 1), rf"^{S}+|{S}+$", "")


def _slug(target: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(target), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# Fenced code, a reference's id up to version or clause, an id that counts, a wiki link's target, generated links.
FENCES = r"(?s)```.*?```|~~~.*?~~~"
REFERENCE = r"""@spec[\t\n\f\r ]+req://([^@#\t\n\f\r "'`]+)"""
REFERENCE_ID = r"^[a-z0-9][a-z0-9/_-]*\z"
LINK = r"""\[\[([^\t\n\f\r |#"$\[\]][^|#"$\[\]\n]*)(?:[#|][^\[\]\n]*)?\]\]"""
GENERATED = r"^_[A-Z]+_"


def ref_tags(content: Column) -> Column:
    """spec: and link: tags of the references in the whole content, frontmatter too, outside fenced code, specs first, without repeats."""
    text = F.regexp_replace(content, FENCES, "")
    ids = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, "^/+|/+$", "")))
    specs = F.transform(F.filter(ids, lambda x: x.rlike(REFERENCE_ID)), lambda x: F.concat(F.lit("spec:"), x))
    targets = F.filter(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: ~x.rlike(GENERATED))
    links = F.transform(F.filter(F.transform(targets, _slug), lambda x: x != ""), lambda x: F.concat(F.lit("link:"), x))
    return F.array_distinct(F.concat(specs, links))


def combined_tags(content: Column) -> Column:
    return F.concat_ws(", ", F.nullif(raw_tags(content), F.lit("")), F.nullif(F.array_join(ref_tags(content), ", "), F.lit("")))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != "")


def normalized_tags(tags: Column) -> Column:
    """For lists in brackets: one leading and one trailing bracket go first."""
    return split_tags(F.regexp_replace(F.regexp_replace(F.trim(tags), r"^\[", ""), r"\]$", ""))


def summary(text: Column) -> Column:
    """The first paragraph: lines trimmed, those that begin with # left out, up to the first blank line after the start; 300 code points."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, rf"^{S}+|{S}+$", ""))
    start = F.struct(F.lit(False).alias("over"), F.lit("").alias("text"))

    def step(a: Column, x: Column) -> Column:
        over = a["over"] | ((x == "") & (a["text"] != ""))
        grown = F.when(a["text"] == "", x).otherwise(F.concat(a["text"], F.lit(" "), x))
        return F.struct(over.alias("over"), F.when(over | (x == "") | x.startswith("#"), a["text"]).otherwise(grown).alias("text"))

    return F.substring(F.aggregate(lines, start, step)["text"], 1, SUMMARY_POINTS)


def kind_of_id(ref: Column) -> Column:
    return F.regexp_extract(ref, CANONICAL, 1)


def fallback_id(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), F.replace(path, F.lit("\\"), F.lit("/")))


def typed_edges(rows: DataFrame) -> DataFrame:
    """Edges (src, dst, type, repo, path, field) of rows (node_id, repo, path, fields map<string, array<string>>). Repeats count once."""
    listed = rows.select("node_id", "repo", "path", F.explode("fields").alias("field", "refs")).where(F.col("field").isin(*EDGES))
    refs = listed.select("node_id", "repo", "path", "field", F.explode("refs").alias("ref"))
    kind = F.element_at(F.create_map(*(F.lit(x) for p in EDGES.items() for x in p)), F.col("field"))
    back = F.col("field").isin(*REVERSED)
    return refs.select(F.when(back, F.col("ref")).otherwise(F.col("node_id")).alias("src"), F.when(back, F.col("node_id")).otherwise(F.col("ref")).alias("dst"), kind.alias("type"), "repo", "path", "field").dropDuplicates()


def unrecognized_fields(fields: Column) -> Column:
    """Fields outside the table with a value shaped like an id, sorted."""
    known = [*EDGES, *PLAIN_FIELDS]
    return F.array_sort(F.filter(F.map_keys(fields), lambda k: ~k.isin(known) & F.exists(F.element_at(fields, k), lambda v: v.rlike(CANONICAL))))


def parse_frontmatter(content: Column) -> Column:
    """struct(fields map<string, array<string>>, id string, malformed boolean) of each text's frontmatter; fields' values are the text leaves in order, id is that field if it is one text."""

    @F.pandas_udf("fields map<string,array<string>>, id string, malformed boolean")
    def parsed(raw: pd.Series) -> pd.DataFrame:
        found = [frontmatter_values(x) for x in raw]
        ids = [f["id"].strip() if isinstance(f.get("id"), str) else None for f, _ in found]
        return pd.DataFrame({"fields": [{k: _leaves(v) for k, v in f.items()} for f, _ in found], "id": ids, "malformed": [m for _, m in found]})

    return parsed(frontmatter_raw(content))


def _leaves(value) -> list[str]:
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    return [x for v in value for x in _leaves(v)] if isinstance(value, list) else []


@functools.cache
def _loader() -> type:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    # YAML 1.2's core schema: only null, booleans, integers and floats are no text.
    Loader.yaml_implicit_resolvers = {}
    Loader.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"^(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?[0-9]+$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$"), list("-+0123456789."))

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) != len(keys):
            raise yaml.YAMLError("a key stands twice")
        return {str(k): loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


def _relaxed(line: str) -> str:
    m = re.match(r"^([A-Za-z0-9_-]+):[ \t]+(.*?)[ \t]*$", line)
    if not m or m[2][:1] in ("'", '"', "[", "{", "|", ">", "&", "*", "!", "#") or not (": " in m[2] or m[2].endswith(":")):
        return line
    return f"{m[1]}: '" + m[2].replace("'", "''") + "'"


def frontmatter_values(raw: str | None) -> tuple[dict[str, object], bool]:
    """(values by field, whether the block is malformed). A block that is no YAML is tried again with plain top-level values that hold ": " or end with ":" in quotes."""
    import yaml

    if not raw:
        return {}, False
    for text in (raw, "\n".join(map(_relaxed, raw.split("\n")))):
        try:
            got = yaml.load(text, _loader())
        except (yaml.YAMLError, ValueError):
            continue
        if got is None:
            return {}, False
        if isinstance(got, dict):
            return got, False
        break
    return {}, True


def frontmatter_fields(raw: str | None) -> tuple[dict[str, list[str]], bool]:
    """(text leaves by field, whether the block is malformed)."""
    values, malformed = frontmatter_values(raw)
    return {k: _leaves(v) for k, v in values.items()}, malformed
