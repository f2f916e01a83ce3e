"""Folders of documents as spec rows: which files are read, companions of media, what is extracted."""

from __future__ import annotations

import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract

# File types, and the most that is read of a file.
TEXT, MEDIA, MOST = ("md", "mdx", "txt"), ("jpg", "jpeg", "png", "gif", "webp", "svg", "pdf"), 10 << 20


def skip_names(names: list[str]) -> list[str]:
    """Folder names without blanks, dots and separators, each once, sorted."""
    own = {n.strip() for n in names}
    return sorted(n for n in own if n not in ("", ".", "..") and not any(c in n for c in "/\\|,"))


def ignore_line(raw: str) -> str | None:
    """The folder that a line of an ignore file names by its bare name or as "dir/"; None for comments, negations, patterns, longer paths and bare names at the root."""
    line = raw.strip()
    if not line or line[0] in "#!" or re.search(r"[*?\[\]|,\\]", line):
        return None
    rooted, folder = line.startswith("/"), line.endswith("/")
    name = line.strip("/")
    if not name or "/" in name or name in (".", "..") or (rooted and not folder):
        return None
    return name


def ignored_folder(line: Column) -> Column:
    """ignore_line() of a column."""

    @F.pandas_udf("string")
    def named(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: None if x is None else ignore_line(x))

    return named(line)


def ignored_folders(text: str) -> list[str]:
    return skip_names([n for n in map(ignore_line, text.split("\n")) if n])


def without_skipped(rows: DataFrame, skip: list[str]) -> DataFrame:
    """Rows whose path has none of the folders; the file's own name doesn't count."""
    if not skip:
        return rows
    parts = F.split("path", "/")
    return rows.where(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skip))))


def folders(spark: SparkSession, root: str, skip: list[str] = ()) -> tuple[str, list[str]]:
    """(root, folders): the root as Spark names it, and it and all folders below that are not skipped and not below a skipped one. Folders that can't be read are left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [system.makeQualified(path)]
    while todo:
        at = todo.pop()
        try:
            listed = list(system.listStatus(at))
        except Py4JJavaError:
            continue
        out.append(at.toString())
        todo += [x.getPath() for x in listed if x.isDirectory() and x.getPath().getName() not in skip]
    return system.makeQualified(path).toString(), sorted(out)


def _any_case(endings: tuple[str, ...]) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings) + "}"


#: How Spark is told that a path is no pattern.
PATTERN_SIGNS = re.compile(r"([{}\[\]*?\\])")
#: Stands for a replacement character that is in a file, while those for bad bytes are put in.
KEPT = "\ufdd0"


def valid_text(raw: Column) -> Column:
    """Bytes as text; each run of bad bytes is one U+FFFD."""
    marked = F.make_valid_utf8(F.replace(raw.cast("string"), F.lit("\ufffd"), F.lit(KEPT)))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.replace(F.regexp_replace(marked, "\ufffd+", "\ufffd"), F.lit(KEPT), F.lit("\ufffd")))


def read_folder(spark: SparkSession, root: str, repo: str, skip: list[str] = (), within: set[str] | None = None) -> DataFrame:
    """(repo, path, ext, modified_unix, size, content) of the text and media files below root; content is the first 10 MiB of texts, bad bytes replaced, and null for media, which are not read. Skipped folders are not listed; of others only those within (relative to root, "" for itself) are read, if given."""
    base, places = folders(spark, root, list(skip))
    if within is not None:
        places = [p for p in places if p[len(base.rstrip("/")) + 1 :] in within]
    if not places:
        return spark.createDataFrame([], "repo string, path string, ext string, modified_unix long, size long, content string")
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = lambda endings: spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", _any_case(endings)).load([PATTERN_SIGNS.sub(r"\\\1", p) for p in places])
    inner = F.substring(F.col("path"), F.lit(len(base.rstrip("/")) + 2), F.length("path"))
    columns = [F.lit(repo).alias("repo"), inner.alias("path"), extract.extension(F.col("path")).alias("ext"), F.unix_timestamp("modificationTime").alias("modified_unix"), F.col("length").alias("size")]
    texts = read(TEXT).select(*columns, valid_text(F.substring("content", 1, MOST)).alias("content"))
    return texts.union(read(MEDIA).select(*columns, F.lit(None).cast("string").alias("content")))


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def with_companions(files: DataFrame) -> DataFrame:
    """The documents among files: media take the text of the .md beside them (none or an empty one: they go), and texts beside media are no documents of their own."""
    marked = files.withColumn("stem", _stem(F.col("path")))
    media, texts = marked.where(F.col("ext").isin(*MEDIA)), marked.where(F.col("ext").isin(*TEXT))
    notes = texts.where("ext = 'md' and size > 0").select("repo", "stem", F.col("content").alias("note"))
    told = media.join(notes, ["repo", "stem"]).withColumn("content", F.col("note"))
    alone = texts.join(media.select("repo", "stem").distinct(), ["repo", "stem"], "left_anti")
    return alone.select(*files.columns).unionByName(told.select(*files.columns))


def specs(files: DataFrame) -> DataFrame:
    """Spec rows of documents (repo, path, ext, modified_unix, size, content), with identity, fields and edges' sources."""
    name = extract.base_name(F.col("path"))
    read = files.withColumn("name", name).withColumn("front", extract.parse_frontmatter(F.col("content")))
    own_id = F.col("front.id")
    canonical = F.when(own_id.rlike(extract.CANONICAL), own_id)
    tags = extract.combined_tags(F.col("content"))
    return read.select(
        extract.fallback_id(F.col("repo"), F.col("path")).alias("spec_id"),
        "repo",
        "path",
        extract.project(F.col("path")).alias("project"),
        "name",
        extract.title(F.col("content"), F.col("name")).alias("title"),
        tags.alias("tags_raw"),
        extract.split_tags(tags).alias("tags"),
        extract.summary(extract.body(F.col("content"))).alias("summary"),
        "modified_unix",
        "size",
        "ext",
        "content",
        F.coalesce(canonical, extract.fallback_id(F.col("repo"), F.col("path"))).alias("node_id"),
        F.coalesce(extract.kind_of_id(canonical), F.lit("file")).alias("kind"),
        F.col("front.fields").alias("fields"),
        F.col("front.malformed").alias("malformed"),
        extract.unrecognized_fields(F.col("front.fields")).alias("unrecognized"),
    )


def declarations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decls, edges) of spec rows."""
    decls = rows.select("repo", "path", F.col("node_id").alias("id"), "kind", "title").dropDuplicates(["repo", "path", "id"])
    return decls, extract.typed_edges(rows)
