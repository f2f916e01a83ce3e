"""Upkeep of spec tables: changes merged in, repositories replaced or removed, the result equal to a full rebuild."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from ..sources import files, registry
from . import fts, segments, semantic
from .commits import Conflict, Lease, Log
from .kg import fingerprint, resolve


def changed(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Rows of disk (repo, path, modified_unix, size, ...) whose time or size isn't the stored one."""
    known = stored.select("repo", "path", F.col("modified_unix").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_k"))
    met = disk.join(known, ["repo", "path"], "left")
    return met.where(F.col("_k").isNull() | ~F.col("modified_unix").eqNullSafe(F.col("_m")) | ~F.col("size").eqNullSafe(F.col("_s"))).select(*disk.columns)


def upsert(base: DataFrame, new: DataFrame, deleted: DataFrame | None = None, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """base with the rows of new in place of those of equal keys, and without the deleted keys."""
    gone = new.select(*keys) if deleted is None else new.select(*keys).union(deleted.select(*keys))
    return base.join(gone.distinct(), list(keys), "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def replace_repo(base: DataFrame, new: DataFrame, repo: str) -> DataFrame:
    return base.where(F.col("repo") != repo).unionByName(new.select(*base.columns))


def delete_repo(base: DataFrame, repo: str) -> DataFrame:
    return base.where(F.col("repo") != repo)


def write_repos(df: DataFrame, path: str) -> None:
    """Overwrites only the partitions (repo) that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def resolved_if_changed(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], nodes: DataFrame) -> DataFrame:
    """nodes as they are if declarations and edges have the same fingerprint, else resolved anew."""
    same = fingerprint(*before).collect() == fingerprint(*after).collect()  # one row each
    return nodes if same else resolve(*after)


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that one of the two has more often than the other."""
    new = new.select(*old.columns)
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def touched_ids(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(id): those whose declarations, or whose part in edges, are not what they were; before and after need hold the changed repos alone."""
    decls, edges = (_differing(a, b) for a, b in zip(before, after, strict=True))
    return decls.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()


def resolved_again(nodes: DataFrame, touched: DataFrame, decls: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with those of the touched ids (id) resolved anew from all declarations and edges: an entity depends on its id's rows alone, so others stay. Equal to resolve(decls, edges)."""
    own = decls.join(touched, "id", "left_semi")
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).join(touched, "id", "left_semi").distinct()
    return nodes.join(touched, "id", "left_anti").unionByName(resolve(own, ends.select(F.col("id").alias("src"), F.col("id").alias("dst"))).select(*nodes.columns))


#: Tables of the store; all but nodes are kept by repo.
TABLES = ("specs", "decls", "edges", "vectors", "nodes")
BY_REPO = TABLES[:-1]


@dataclass
class Store:
    """The tables of all registered repos, and their full-text index, in a folder that all machines share.

    A commit of the log names each repo's files, the entities' file, the index's version and the meta values, so readers see all of a
    change or nothing of it. A change writes its own repo's files. Two changes of unlike repos both come through: the second to commit
    takes the first one's files over and resolves the entities again; of two of one repo, the second is a Conflict."""

    spark: SparkSession
    path: str
    indexed: bool = True

    @property
    def log(self) -> Log:
        return Log(self.spark, f"{self.path}/log")

    def state(self) -> dict | None:
        return self.log.latest()[1]

    def version(self) -> int | None:
        found = self.log.versions()
        return found[-1] if found else None

    def write(self, df: DataFrame) -> dict:
        """df's place and schema, once it is written."""
        place = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return {"place": place, "schema": df.schema.json()}

    def read(self, state: dict, name: str, repos: list[str] | None = None) -> DataFrame:
        """A table of some repos, or of all."""
        parts = [state["nodes"]] if name == "nodes" else [own[name] for r, own in sorted(state["repos"].items()) if repos is None or r in repos]
        if not parts:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(state["schemas"][name])))
        return self.spark.read.schema(StructType.fromJson(json.loads(parts[0]["schema"]))).parquet(*(x["place"] for x in parts))

    def tables(self) -> dict[str, DataFrame]:
        state = self.state()
        return {} if state is None else {t: self.read(state, t) for t in TABLES}

    def meta(self) -> dict[str, str]:
        state = self.state()
        return {} if state is None else state["meta"]

    def index(self) -> segments.Segments | None:
        """The full-text index that belongs to the tables."""
        state = self.state()
        return None if state is None or not state["index"] else segments.Segments(self.spark, state["index"]["place"], state["index"]["version"])

    def vectors(self) -> semantic.Vectors:
        return semantic.Vectors(self.tables()["vectors"])

    def vacuum(self) -> None:
        """Deletes the files that the newest commit does not name; readers of older ones lose theirs."""
        state, system, Path = self.state(), self.log.system(), self.spark._jvm.org.apache.hadoop.fs.Path
        named = {x["place"].rpartition("/")[2] for own in state["repos"].values() for x in own.values()} | {state["nodes"]["place"].rpartition("/")[2]}
        for x in system.globStatus(Path(f"{self.path}/data/*")) or []:
            if x.getPath().getName() not in named:
                system.delete(x.getPath(), True)


def _tables_of(store: Store, specs: DataFrame) -> dict[str, dict]:
    """A repo's files, written: its specs, and what follows from them."""
    own = {"specs": store.write(specs)}
    written = store.spark.read.schema(specs.schema).parquet(own["specs"]["place"])
    decls, edges = files.declarations(written)
    return own | {"decls": store.write(decls), "edges": store.write(edges), "vectors": store.write(semantic.index(written).weights)}


def _reindexed(store: Store, index: dict, changed: DataFrame | None, gone: DataFrame) -> dict:
    """The index's place and version after a change, whatever other changes came to it meanwhile."""
    while True:
        try:
            return {"place": index["place"], "version": segments.Segments(store.spark, index["place"]).updated(changed, gone).version}
        except Conflict:
            continue  # each conflict is another's commit, so there is progress


def _commit(store: Store, repo: str, seen: dict | None, own: dict[str, dict] | None, index: dict | None, told: dict[str, str | None]) -> None:
    """Puts a repo's new files (none: the repo goes) into the newest commit; Conflict if its files there are not those seen. told: meta values, None for those that go."""

    def make(version: int, state: dict) -> dict:
        if state["repos"].get(repo) != seen:
            raise Conflict(f"{repo} was changed by another writer")
        repos = {r: x for r, x in state["repos"].items() if r != repo} | ({repo: own} if own else {})
        new = state | {"repos": repos, "meta": {k: v for k, v in (state["meta"] | told).items() if v is not None}}
        pair = lambda s, only=None: (store.read(s, "decls", only), store.read(s, "edges", only))
        touched = cut(touched_ids(pair(state, [repo]), pair(new, [repo])))
        if not touched.isEmpty():
            new["nodes"] = store.write(resolved_again(store.read(state, "nodes"), touched, *pair(new)))
        if index and state["index"]:
            new["index"] = index if index["place"] != state["index"]["place"] or index["version"] > state["index"]["version"] else state["index"]
        return new

    store.log.change(make)


def _specs(spark: SparkSession, repo: registry.Repo) -> DataFrame:
    return files.specs(files.with_companions(files.read_folder(spark, repo.path, repo.name, repo.skip)))


def rebuild(store: Store, repos: list[registry.Repo], now: str, heads: dict[str, str] | None = None) -> None:
    """All tables of all repos made anew, with one time for all that was scanned."""
    own = {r.name: _tables_of(store, _specs(store.spark, r)) for r in repos}
    schemas = {t: next(iter(own.values()))[t]["schema"] for t in BY_REPO} if own else {}
    state = {"repos": own, "schemas": schemas, "index": None}
    state["nodes"] = store.write(resolve(store.read(state, "decls"), store.read(state, "edges")))
    if store.indexed:
        place = f"{store.path}/index/{uuid.uuid4().hex}"
        state["index"] = {"place": place, "version": segments.create(store.spark, place, store.read(state, "specs"), fts.COLUMNS).version}
    state["meta"] = {"last_scan": now} | {f"last_scan_{r.name}": now for r in repos} | {f"git_commit_{n}": h for n, h in (heads or {}).items()}
    store.log.change(lambda version, before: state)


def refresh(store: Store, repo: registry.Repo, now: str) -> int:
    """Brings one repo's rows up to date: of the files that git tells changed, those whose time or size is new are read again and those that are gone go, from the tables, the index and the vectors. Entities that the change touches are resolved again. The number of specs written; the tables equal those of a rebuild."""
    state = store.state()
    names, head = registry.changed_files(repo.path, state["meta"].get(f"git_commit_{repo.name}"), (*files.TEXT, *files.MEDIA))
    names = [n for n in names if not set(n.split("/")[:-1]) & set(repo.skip)]
    if not names:
        return 0
    spark, specs = store.spark, store.read(state, "specs", [repo.name])
    # A file may be the companion of others of its stem, so all files of a changed stem are judged together.
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    stems = spark.createDataFrame([(n,) for n in names], "path string").select(stem.alias("stem")).distinct()
    disk = files.read_folder(spark, repo.path, repo.name, repo.skip, {n.rpartition("/")[0] for n in names}).withColumn("stem", stem).join(stems, "stem", "left_semi").drop("stem")
    there = files.with_companions(disk)
    stored = specs.withColumn("stem", stem).join(stems, "stem", "left_semi").drop("stem")
    # A companion's text may change while its picture does not: media are read whenever their stem changed.
    new = cut(files.specs(changed(stored, there.where(F.col("ext").isin(*files.TEXT))).unionByName(there.where(F.col("ext").isin(*files.MEDIA)))))
    gone = cut(stored.join(there.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", "spec_id"))
    own = _tables_of(store, upsert(specs, new.select(*specs.columns), gone.select("repo", "path")))
    index = _reindexed(store, state["index"], new, gone.select("spec_id")) if state["index"] else None
    told = {"last_scan": now, f"last_index_update_{repo.name}": now} | ({f"git_commit_{repo.name}": head} if head else {})
    _commit(store, repo.name, state["repos"].get(repo.name), own, index, told)
    return new.count()


def drop(store: Store, repo: str, now: str) -> None:
    """A repo's rows go from all tables and the index, and what was resolved with them is resolved again."""
    state = store.state()
    index = _reindexed(store, state["index"], None, store.read(state, "specs", [repo]).select("spec_id")) if state["index"] else None
    _commit(store, repo, state["repos"].get(repo), None, index, {k: None for k in state["meta"] if k.endswith(f"_{repo}")} | {"last_scan": now})


def triggered(store: Store, repo: registry.Repo, now: str, ttl: float = 3600.0) -> int | None:
    """What a hook does: refreshes the repo if it is due. None if another trigger is at it, else the number of specs written."""
    with Lease(store.spark, store.path, registry.lock_name(repo.name), ttl) as held:
        if not held:
            return None
        last = store.meta().get(f"git_commit_{repo.name}")
        return refresh(store, repo, now) if due(repo.path, last) else 0


def due(root: str, last: str | None) -> bool:
    """Whether a hook has reason to scan a repo: git tells of changed specs since the last scan's commit, or cannot tell; without git there always is."""
    try:
        names, head = registry.changed_files(root, last)
    except registry.GitError:
        return True
    return bool(names) or head is None
