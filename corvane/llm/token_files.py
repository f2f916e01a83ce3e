"""Operator 5: token-ID output. Whole texts become ids in files of Simple-8b blocks, in ascending doc_id order, and are read back.

A file is a Parquet file of blocks, as Spark's writer makes it, so it may lie in any store that Spark reaches. A block has
whole documents of about BLOCK_IDS ids: the ids of its documents, how many ids each has, where the block begins among its
shard's ids and the words of all ids, so any block is decoded by itself.

Nulls: a null text is an empty one, which has the end id alone; rows with a null doc_id come first. Rows of equal doc_id
are kept, ordered by text. An empty table gives no blocks. Other columns of the input are not read."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import cut, parts, shared_folder
from .tokens import encoder

BLOCK_IDS = 1 << 16
#: Shards whose offsets (16 bytes each) are broadcast; more of them meet the blocks in a join.
SHARDS = 1 << 16
BLOCKS = "shard int, block int, first_id long, doc_ids array<long>, n_ids array<long>, words binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, partitions: int | None = None) -> None:
    """docs (doc_id, text) as token files in the folder path. The range partitioning reads doc_id and text twice, but encodes once."""
    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions or parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("words", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first, held, ids, raw = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def done() -> pa.RecordBatch:
            nonlocal block, first, held, ids, raw
            joined = b"".join(raw)
            out = [shard], [block], [first], [ids], [[len(x) // 4 for x in raw]], [simple8b.encode(np.frombuffer(joined, "<u4"))]
            block, first, held, ids, raw = block + 1, first + len(joined) // 4, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        tokens = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, got in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    raw.append(got + end)
                    held += len(raw[-1]) // 4
                    if held >= BLOCK_IDS:
                        yield done()
        if ids:
            yield done()

    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids before it in all files. Ids alone: tokens(spark, path)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row for each shard meets in the window, whatever the number of documents.
    shards = cut(blocks.groupBy("shard").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")))
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    before = before.select("shard", F.coalesce("before", F.lit(0)).alias("before"))
    based = blocks.join(F.broadcast(before) if shards.count() <= SHARDS else before, "shard").select((F.col("before") + F.col("first_id")).alias("first_id"), "doc_ids", "n_ids", "words")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs, counts, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                counts = np.array(counts)
                ends = np.cumsum(counts)
                ids = simple8b.decode(raw, int(ends[-1])).astype("<u4")
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    return based.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of each document in the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = simple8b.decode(raw, sum(counts)).astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], schema=schema)

    return spark.read.schema(BLOCKS).parquet(path).select("doc_ids", "n_ids", "words").mapInArrow(whole, "doc_id long, ids array<int>")


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
