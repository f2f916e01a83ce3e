"""A full-text index as a log of immutable segments, with an upper bound of each block's scores.

A segment's specs are dealt to blocks of SLOTS in order of length, so a block's specs score alike. Its tables are
    docs      block, slot, spec_id, n_tokens, tokens (an array for each column)
    blocks    block, specs array<struct<slot, spec_id, n_tokens>>
    postings  term, block, n_docs, max_tf, min_len, places; in order of term and block, so Parquet prunes the rest
A place is slot << 40 | column << 32 | position. From max_tf and min_len follows the most that a block's specs can score by a
term, whatever the mean length is then; top() (fts.top) reads the places of blocks that can enter the best alone.

A change writes a segment of the changed specs and a batch of entries that are gone, with their terms, so that numbers of
specs are right without a look at other postings. When PER_TIER segments are of one size, they become one; so a spec is
written again some log(specs) times in all. What is live stands in a commit of a log: readers keep what they opened."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem, tokens
from .commits import Log

SLOTS, SLOT, COLUMN = 16, 1 << 40, 1 << 32
#: Segments of one tier before they become one, and how much larger each tier is.
PER_TIER, GROWTH = 4, 4
#: Blocks or entries up to which a list of them is broadcast (some 20 bytes each).
FEW = 1 << 18

POSTINGS = "term string, block long, n_docs int, max_tf int, min_len long, places array<long>"
_postings = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n_docs", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int64()), ("places", pa.list_(pa.int64()))])
DOCS = "block long, slot int, spec_id string, n_tokens long, tokens array<array<string>>"


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where a row of keys in order differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = functools.reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    return np.flatnonzero(new)


def _grouped(porter: bool, n_columns: int):
    """Postings of the specs of each Arrow batch. A block that two batches share gives two rows for a term; sums, maxima and places of both are right together."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stemmed = functools.lru_cache(1 << 16)(stem)
        for batch in batches:
            block, slot, size = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            texts = batch.column(3).flatten()
            offsets = np.asarray(texts.offsets, np.int64)
            n = np.diff(offsets)
            words = texts.flatten().dictionary_encode()
            if not len(words):
                continue
            column, own = np.tile(np.arange(n_columns), batch.num_rows), np.repeat(np.arange(batch.num_rows), n_columns)
            place = np.repeat(slot[own] * SLOT + column * COLUMN, n) + np.arange(len(words)) - np.repeat(offsets[:-1] - offsets[0], n)
            doc, ids, book = np.repeat(own, n), words.indices.to_numpy().astype(np.int64), words.dictionary
            if porter:
                coded = pa.array([stemmed(w) for w in book.to_pylist()], pa.string()).dictionary_encode()
                ids, book = coded.indices.to_numpy().astype(np.int64)[ids], coded.dictionary
            order = np.lexsort((place, block[doc], ids))
            place, doc, ids = place[order], doc[order], ids[order]
            each = _begins(ids, doc)  # a spec's places of a term
            tf = np.diff(np.append(each, len(ids)))
            first = _begins(ids[each], block[doc[each]])
            starts = each[first]
            yield pa.RecordBatch.from_arrays([
                book.take(pa.array(ids[starts])),
                pa.array(block[doc[starts]]),
                pa.array(np.diff(np.append(first, len(each))).astype(np.int32)),
                pa.array(np.maximum.reduceat(tf, first).astype(np.int32)),
                pa.array(np.minimum.reduceat(size[doc[each]], first)),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), pa.array(place)),
            ], schema=_postings)

    return group


class Segments:
    """An index in a folder, as of the commit that stood when it was opened."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, f"{path.rstrip('/')}/log")
        self.version, self.state = self.log.latest() if version is None else (version, self.log.read(version))
        if self.state is None:
            raise FileNotFoundError(f"no index in {path}")
        self.columns, self.porter = tuple(self.state["columns"]), self.state["porter"]

    # Reading

    @property
    def live(self) -> list[int]:
        return [s["segment"] for s in self.state["segments"]]

    def _table(self, name: str, segments: list[int] | None = None) -> DataFrame:
        chosen = self.live if segments is None else segments
        schema = {"docs": DOCS, "postings": POSTINGS, "blocks": "block long, specs array<struct<slot: int, spec_id: string, n_tokens: long>>"}[name]
        if not chosen:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        read = self.spark.read.schema(f"{schema}, segment int").option("basePath", f"{self.path}/{name}")
        return read.parquet(*(f"{self.path}/{name}/segment={s}" for s in chosen))

    def gone(self) -> DataFrame | None:
        """(segment, block, slot, terms, spec_id, n_tokens) of entries that are no more."""
        batches = self.state["gone"]
        if not batches:
            return None
        schema = "segment int, block long, slot int, spec_id string, n_tokens long, terms array<string>"
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/gone/{b['batch']}" for b in batches)).where(F.col("segment").isin(self.live))

    def _n_gone(self) -> int:
        return sum(n for b in self.state["gone"] for s, (n, _) in b["segments"].items() if int(s) in self.live)

    def totals(self) -> tuple[int, int]:
        """How many specs there are, and their tokens."""
        docs, size = (sum(s[k] for s in self.state["segments"]) for k in ("n_docs", "n_tokens"))
        for b in self.state["gone"]:
            for s, (n, t) in b["segments"].items():
                if int(s) in self.live:
                    docs, size = docs - n, size - t
        return docs, size

    def whole(self) -> DataFrame:
        """One row: the number of specs and their mean length."""
        docs, size = self.totals()
        return self.spark.range(1).select(F.lit(docs).cast("long").alias("n_docs"), F.lit(size / docs if docs else None).cast("double").alias("mean_tokens"))

    def none(self) -> DataFrame:
        return self.spark.createDataFrame([], "spec_id string, rank double")

    def _of(self, wanted: set[tuple[str, bool]]) -> DataFrame:
        exact, prefixes = sorted(t for t, p in wanted if not p), sorted(t for t, p in wanted if p)
        held = F.col("term").isin(exact) if exact else F.lit(False)
        for t in prefixes:
            held = held | F.col("term").startswith(t)
        return self._table("postings").where(held)

    def bounds(self, wanted: list[tuple[str, bool]]) -> DataFrame:
        """(segment, block, tf0, len0, tf1, len1 ...): for each wanted term (a prefix: all its terms together) the most places in a spec of the block and the least length of such a spec; null if the block has none. Places are not read."""
        is_ = lambda w: F.col("term").startswith(w[0]) if w[1] else F.col("term") == w[0]
        together = lambda w: F.sum if w[1] else F.max
        # A term that stands in two rows of a block has its larger maximum, a prefix the sum of its terms' maxima.
        each = self._of(set(wanted)).groupBy("segment", "block", "term").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        made = [c for k, w in enumerate(wanted) for c in (together(w)(F.when(is_(w), F.col("max_tf"))).cast("long").alias(f"tf{k}"), F.min(F.when(is_(w), F.col("min_len"))).alias(f"len{k}"))]
        return each.groupBy("segment", "block").agg(*made)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many specs have each term. One row for each term comes to the driver."""
        if not terms:
            return {}
        out = dict.fromkeys(terms, 0) | {r["term"]: r["n"] for r in self._of({(t, False) for t in terms}).groupBy("term").agg(F.sum("n_docs").cast("long").alias("n")).collect()}
        if (gone := self.gone()) is not None:
            for r in gone.select(F.explode("terms").alias("term")).where(F.col("term").isin(terms)).groupBy("term").count().collect():
                out[r["term"]] -= r["count"]
        return out

    def dictionary(self) -> DataFrame:
        """(term, n_places, n_specs) of each term, from the postings' heads and how many places they list; what is gone is taken off."""
        all_ = self._table("postings").select("term", F.size("places").cast("long").alias("p"), F.col("n_docs").cast("long").alias("n"))
        if (gone := self.gone()) is not None:
            words = F.flatten("tokens")
            lost = self._table("docs").join(gone.select("segment", "block", "slot"), ["segment", "block", "slot"], "left_semi").select("segment", "block", "slot", F.explode(_stems(words) if self.porter else words).alias("term"))
            all_ = all_.union(lost.groupBy("segment", "block", "slot", "term").agg((-F.count("*")).alias("p")).select("term", "p", F.lit(-1).cast("long")))
        return all_.groupBy("term").agg(F.sum("p").alias("n_places"), F.sum("n").alias("n_specs")).where("n_specs > 0")

    def places(self, wanted: set[tuple[str, bool]], blocks: DataFrame | None = None, few: bool = True) -> DataFrame:
        """(spec_id, n_tokens, places array<struct<term, at>>): where the wanted terms stand, in all blocks or in those given (segment, block), of which few are broadcast."""
        rows, held = self._of(wanted).select("segment", "block", "term", "places"), self._table("blocks")
        if blocks is not None:
            own = F.broadcast(blocks) if few else blocks
            rows, held = rows.join(own, ["segment", "block"], "left_semi"), held.join(own, ["segment", "block"], "left_semi")
        # By block: what follows needs no other shuffle.
        met = rows.join(held, ["segment", "block"]).select("segment", "block", "specs", "term", F.explode("places").alias("place"))
        slot = F.floor(F.col("place") / SLOT).cast("int")
        spec = F.filter("specs", lambda s: s["slot"] == slot)[0]
        each = met.select("segment", "block", slot.alias("slot"), spec.alias("spec"), F.struct("term", F.pmod("place", F.lit(SLOT)).alias("at")).alias("place"))
        by = each.groupBy("segment", "block", "slot").agg(F.first("spec").alias("spec"), F.collect_list("place").alias("places"))
        if (gone := self.gone()) is not None:
            dead = gone.select("segment", "block", "slot")
            by = by.join(F.broadcast(dead) if self._n_gone() <= FEW else dead, ["segment", "block", "slot"], "left_anti")
        return by.select("spec.spec_id", "spec.n_tokens", "places")

    # Writing

    def _write(self, docs: DataFrame) -> dict:
        """A segment of (spec_id, size, and what gives tokens): docs has size, spec_id and tokens."""
        number = uuid.uuid4().int & 0x7FFFFFFF
        own = lambda name: f"{self.path}/{name}/segment={number}"
        ordered = docs.repartitionByRange("size", "spec_id").sortWithinPartitions("size", "spec_id").withColumn("id", F.monotonically_increasing_id())
        length = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + F.size(x))
        block, slot = F.floor(F.col("id") / SLOTS), F.pmod("id", F.lit(SLOTS)).cast("int")
        ordered.select(block.alias("block"), slot.alias("slot"), "spec_id", "tokens").select("block", "slot", "spec_id", length.alias("n_tokens"), "tokens").write.parquet(own("docs"))
        written = self.spark.read.schema(DOCS).parquet(own("docs"))
        written.groupBy("block").agg(F.collect_list(F.struct("slot", "spec_id", "n_tokens")).alias("specs")).write.parquet(own("blocks"))
        postings = written.select("block", "slot", "n_tokens", "tokens").mapInArrow(_grouped(self.porter, len(self.columns)), POSTINGS)
        postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(own("postings"))
        n, size = written.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        return {"segment": number, "n_docs": n, "n_tokens": size}

    def _tokenised(self, specs: DataFrame) -> DataFrame:
        kinds = dict(specs.dtypes)
        flat = [F.concat_ws(", ", c) if kinds[c].startswith("array") else F.coalesce(F.col(c), F.lit("")) for c in self.columns]
        # Ordered by characters, which are known before tokens are made; so each text is tokenised once, behind the shuffle.
        return specs.select("spec_id", F.array(*flat).alias("texts")).select("spec_id", F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("size"), F.transform("texts", tokens).alias("tokens"))

    def _merge(self, state: dict) -> dict:
        """state with segments of one tier, where they are too many, as one; or those of which more than half is gone."""
        lost = {}
        for b in state["gone"]:
            for s, (n, _) in b["segments"].items():
                lost[int(s)] = lost.get(int(s), 0) + n
        alive = lambda s: s["n_docs"] - lost.get(s["segment"], 0)
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(int(math.log(max(alive(s), 1), GROWTH)), []).append(s)
        chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= PER_TIER), None) or [s for s in state["segments"] if 2 * alive(s) < s["n_docs"]]
        if not chosen:
            return state
        old = self.__class__.__new__(self.__class__)
        old.__dict__ = self.__dict__ | {"state": state}
        numbers = [s["segment"] for s in chosen]
        docs = old._table("docs", numbers)
        if (gone := old.gone()) is not None:
            docs = docs.join(gone.select("segment", "block", "slot"), ["segment", "block", "slot"], "left_anti")
        left = [s for s in state["segments"] if s["segment"] not in numbers]
        new = self._write(docs.select("spec_id", F.col("n_tokens").alias("size"), "tokens"))
        kept = [b | {"segments": own} for b in state["gone"] if (own := {s: x for s, x in b["segments"].items() if int(s) not in numbers})]
        return self._merge(state | {"segments": left + ([new] if new["n_docs"] else []), "gone": kept})

    def updated(self, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> Segments:
        """The index after specs were changed or added (rows of specs) and others deleted (spec_id). It has the same rows as one of all specs made anew, and writes in proportion to the change. A change that another writer committed meanwhile is a Conflict."""
        keys = [x.select("spec_id") for x in (changed, deleted) if x is not None]
        if not keys:
            return self
        state, ids = dict(self.state), functools.reduce(DataFrame.union, keys).distinct()
        found = self._table("docs").join(ids, "spec_id", "left_semi")
        if (gone := self.gone()) is not None:
            found = found.join(gone.select("segment", "block", "slot"), ["segment", "block", "slot"], "left_anti")
        terms = F.array_distinct(F.flatten("tokens"))
        entries = found.select("segment", "block", "slot", "spec_id", "n_tokens", terms.alias("terms"))
        if self.porter:
            entries = entries.withColumn("terms", F.array_distinct(_stems("terms")))
        batch = uuid.uuid4().hex
        entries.write.parquet(f"{self.path}/gone/{batch}")
        lost = {str(r["segment"]): [r["n"], r["t"]] for r in self.spark.read.parquet(f"{self.path}/gone/{batch}").groupBy("segment").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}  # a row for each segment
        if lost:
            state["gone"] = [*state["gone"], {"batch": batch, "segments": lost}]
        if changed is not None:
            new = self._write(self._tokenised(changed))
            if new["n_docs"]:
                state["segments"] = [*state["segments"], new]
        self.log.commit(self.version + 1, self._merge(state))
        return Segments(self.spark, self.path)

    def vacuum(self) -> None:
        """Deletes what no commit from this one on names. Readers of older ones lose their files."""
        system, Path = self.log.system(), self.spark._jvm.org.apache.hadoop.fs.Path
        named = {f"segment={s}" for v in self.log.versions() if v >= self.version for s in (x["segment"] for x in self.log.read(v)["segments"])}
        named |= {b["batch"] for v in self.log.versions() if v >= self.version for b in self.log.read(v)["gone"]}
        for name in ("docs", "blocks", "postings", "gone"):
            for x in system.globStatus(Path(f"{self.path}/{name}/*")) or []:
                if x.getPath().getName() not in named:
                    system.delete(x.getPath(), True)


def _stems(column: Column | str) -> Column:
    @F.pandas_udf("array<string>")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(lambda own: [stem(t) for t in own])

    return stems(column)


def create(spark: SparkSession, path: str, specs: DataFrame, columns: tuple[str, ...], porter: bool = False) -> Segments:
    """The index of specs (spec_id and the columns) in a folder that has none."""
    made = Segments.__new__(Segments)
    made.spark, made.path, made.log, made.columns, made.porter = spark, path.rstrip("/"), Log(spark, f"{path.rstrip('/')}/log"), tuple(columns), porter
    segment = made._write(made._tokenised(specs))
    made.log.commit(0, {"columns": list(columns), "porter": porter, "segments": [segment] if segment["n_docs"] else [], "gone": []})
    return Segments(spark, path)
