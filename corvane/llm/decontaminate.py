"""Operator 7: benchmark decontamination by size-partitioned MinHash containment.

Test items are short and documents may be long, so Jaccard signatures of both would hardly ever agree. Instead an item's
signature is searched for in the documents: its shingles of the smallest hashes, more of them the larger the item is.
Items are partitioned by their numbers of shingles; in the partition of items of up to n shingles, a signature has
floor((1 - threshold) * n) + 1 of them. A document that holds the threshold's share of an item's shingles holds one at
least of any that many, so no such document is missed. What is found is verified by exact shingle containment.

Items are taken in blocks of BLOCK_BYTES of text at most (or one item, if that alone is longer), by a hash of their
ids. The signatures and shingles of one block are broadcast, a size that the block bounds, and the documents are scanned for
each block; benchmarks of ordinary size are one block. Documents are never shuffled, so no shingle can be a hot key.

Shingles are those of near_duplicates: five consecutive words; an item of one to four words has one shingle, all its words. So where a
block has items of k < 5 words, documents are probed with their runs of k words too, and a short item is found wherever its words
stand one after the other in a document.

Nulls: rows with a null id or text, and items without words, have no shingles and match nothing. Item rows
of equal ids are one item of all their shingles; document rows of equal ids are a document each, and give a row each. Empty tables give no rows. Other columns are not read by search();
remove() keeps them."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILAR, chunks, cut, gathered, grams, words

BLOCK_BYTES = 16 << 20
#: Upper ends of the size partitions grow by this factor.
GROWTH = 1.5


def signature_size(n: int, threshold: float = SIMILAR) -> int:
    """Of how many shingles the signature of an item of n shingles is: by the upper end of its size partition, n at most."""
    top = 4
    while top < n:
        top = int(top * GROWTH)
    return min(n, int((1 - Fraction(str(threshold))) * top) + 1)


def needed(n: int, threshold: float = SIMILAR) -> int:
    """The least number of common shingles that is the threshold's share of n."""
    return -int(-n * Fraction(str(threshold)) // 1)


def _shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle hashes of items, the row of each and its number of words, in order of row; with repeats."""
    hashes, before = words(data, offs)
    found, row = grams(hashes, before, SHINGLE_WORDS)
    counts = np.diff(before)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    if not len(few):
        return found, row, np.full(len(found), SHINGLE_WORDS)
    short = [grams(hashes[before[i] : before[i + 1]], np.array([0, counts[i]]), int(counts[i]))[0] for i in few]
    size = np.concatenate([np.full(len(found), SHINGLE_WORDS), counts[few]])
    found, row = np.concatenate([found, *short]), np.concatenate([row, few])
    order = np.argsort(row, kind="stable")
    return found[order], row[order], size[order]


def _runs(data: np.ndarray, offs: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of documents' runs of so many words, and the row of each, in order of row; with repeats."""
    hashes, before = words(data, offs)
    each = [grams(hashes, before, k) for k in sizes]
    found, row = (np.concatenate(x) for x in zip(*each, strict=True))
    if len(sizes) == 1:
        return found, row
    order = np.argsort(row, kind="stable")
    return found[order], row[order]


def item_shingles(items: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(item_id, shingle, words, n, signed): the distinct shingles of each item, as hashes, with how many words they have; signed are those in its signature. Equal ids of unlike texts are one item of all their shingles."""
    schema = pa.schema([("item_id", pa.int64()), ("shingle", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("signed", pa.bool_())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            item_of = np.repeat(np.arange(len(ids)), texts.value_lengths().to_numpy())
            pairs = [np.zeros((3, 0), np.uint64)]
            for lo, _, data, offs in chunks(texts.flatten()):
                found, row, size = _shingles(data, offs)
                pairs.append(np.stack([item_of[lo + row].astype(np.uint64), found, size.astype(np.uint64)]))
            item, shingle, size = np.unique(np.concatenate(pairs, axis=1), axis=1)  # in order of item, then shingle
            item = item.astype(np.int64)
            sizes = np.bincount(item, minlength=len(ids))
            rank = np.arange(len(item)) - (np.cumsum(sizes) - sizes)[item]
            signed = rank < np.array([signature_size(int(n), threshold) for n in sizes], np.int64)[item]
            yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(shingle.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(sizes[item]), pa.array(signed)], schema=schema)

    known = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    return known.groupBy("item_id").agg(F.collect_set("text").alias("texts")).mapInArrow(hashed, "item_id long, shingle long, words long, n long, signed boolean")


class Index:
    """Items' shingles as sorted arrays, as a task holds them."""

    def __init__(self, shingle: np.ndarray, item: np.ndarray, signed: np.ndarray):
        order = np.lexsort((item, shingle))
        self.shingle, self.item, self.signed = shingle[order], item[order], signed[order]
        self.signatures = np.unique(self.shingle[self.signed])

    def probe(self, found: np.ndarray) -> np.ndarray:
        """Which of the hashes are in a signature."""
        if not len(self.signatures) or not len(found):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.signatures, found), len(self.signatures) - 1)
        return self.signatures[at] == found

    def contained(self, found: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
        """(item's number, common shingles) of the items that the document of the distinct hashes found contains."""
        signed = np.zeros(len(sizes), bool)
        lo, hi = np.searchsorted(self.shingle, found, "left"), np.searchsorted(self.shingle, found, "right")
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            return []
        at = np.concatenate([np.arange(lo[k], hi[k]) for k in hits])
        signed[self.item[at[self.signed[at]]]] = True  # candidates
        common = np.bincount(self.item[at], minlength=len(sizes))
        return [(int(k), int(common[k])) for k in np.flatnonzero(signed & (common >= least))]


PAIRS = "doc_id long, item_id long, n_shingles long, n_common long"


def _blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    """items in blocks of at most limit bytes of text, by hash of item_id, halved until they fit or hold one item."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = F.sum(F.octet_length("text"))

    def parted(n: int) -> list[DataFrame]:
        if n == 1:
            return [own]
        return [own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]

    n = 1
    while True:
        # A row for each block, which are as many as scans of the documents.
        sizes = own.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("block")).agg(size.alias("size"), F.count_distinct("item_id").alias("n")).collect()
        if all(r["size"] <= limit or r["n"] == 1 for r in sizes):
            return [parted(n)[r["block"]] for r in sorted(sizes, key=lambda r: r["block"])]
        n *= 2


def _found(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """PAIRS of one block of items."""
    rows = item_shingles(items, threshold).toPandas()  # a block's
    ids, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    sizes, signed = np.bincount(item, minlength=len(ids)), rows["signed"].to_numpy(bool)
    runs = sorted({SHINGLE_WORDS, *rows["words"].tolist()})  # five numbers at most
    packed = docs.sparkSession.sparkContext.broadcast((ids, sizes, rows["shingle"].to_numpy(np.int64).view(np.uint64), item, signed))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "n_shingles", "n_common")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, shingle, item, signed = packed.value
        index, least = Index(shingle, item, signed), np.array([needed(int(n), threshold) for n in sizes], np.int64)
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            out: list[tuple] = []
            for lo, _, data, offs in chunks(batch.column(1)):
                hashes, row = _runs(data, offs, runs)
                for i in np.unique(row[index.probe(hashes)]):
                    if docs_of[lo + i] is None:
                        continue
                    own = np.unique(hashes[np.searchsorted(row, i) : np.searchsorted(row, i, "right")])
                    out += [(docs_of[lo + i], int(ids[k]), int(sizes[k]), n) for k, n in index.contained(own, sizes, least)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, PAIRS)


def search(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) for each document (doc_id, text) that contains an item (item_id, text)."""
    found = [_found(docs, block, threshold) for block in _blocks(items, block_bytes)]
    if not found:
        found = [docs.sparkSession.createDataFrame([], PAIRS)]
    return functools.reduce(DataFrame.union, found).withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def remove(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The rows of docs whose documents contain no item, all columns. The found ids are few, but not bounded: a join, whose way Spark picks by size."""
    found = cut(gathered(search(docs, items, threshold).select("doc_id").distinct(), docs.select("doc_id").count()))
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
