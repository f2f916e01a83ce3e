"""Shared pieces: sessions and shared folders, byte-level hashing with numpy, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import math
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Odd multipliers of the polynomial hashes, and their inverses modulo 2**64.
BYTE_BASE, GRAM_BASE = 0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87
BYTE_INV = pow(BYTE_BASE, -1, 1 << 64)
#: A random 64-bit value for each byte value.
BYTE_VALUE = np.random.Generator(np.random.PCG64(42)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[65:91] = BYTE_VALUE[97:123]  # A-Z hash as a-z
#: Bytes of the words that shingles are made of: ASCII letters and digits, and all of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True
SHINGLE_WORDS, SIMILAR = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc.getCheckpointDir()
        if not found:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
            found = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a partition, where fewer of them would only make more files.
FILE_ROWS = 1 << 16


def gathered(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df in no more partitions than so many rows need, but for all cores at once; never in more than it has.

    For what is cut() next: a file for each partition of a shuffle, most with some rows or none, costs the executors more than the rows in them (a local folder starts processes for each)."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, blocks_for(rows, each)))


def forget(df: DataFrame) -> None:
    """Deletes the files of a cut() that nothing reads any more."""
    if df.isStreaming:
        return
    rdd = df._jdf.queryExecution().logical()
    file = rdd.rdd().getCheckpointFile() if rdd.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        delete(df.sparkSession, file.get())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def chunks(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The rows lo..hi, their UTF-8 bytes and the offsets of each row in these; nulls are empty. A chunk has about limit bytes, one row at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, whole[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """out, so that spans() hashes any span of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(BYTE_BASE, len(data)), out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes start..end; equal bytes hash equally wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(BYTE_INV, len(prefix))[start] + (end - start).astype(np.uint64))


def word_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the rows begin and end, and the number of words before each row."""
    inside = WORD_BYTE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    begins[first], ends[last] = inside[first], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, A-Z as a-z, and the number of words before each row."""
    start, end, before = word_places(data, offs)
    return spans(prefix_hash(data, FOLDED_VALUE), start, end), before


def grams(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words of each row, and the row of each."""
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= U(GRAM_BASE)
        out += hashes[j : j + m]
    whole = row[:m] == row[n - 1 :]
    return mix(out[whole]), row[:m][whole]


def shingles(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row. Shingles are five consecutive words; a row of one to four words has one shingle, all its words."""
    for lo, hi, data, offs in chunks(texts, limit):
        hashes, before = words(data, offs)
        found, row = grams(hashes, before, SHINGLE_WORDS)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
        found, row = found[new], row[new]
        at = np.searchsorted(row, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            own = found[at[i] : at[i + 1]]
            if not len(own) and before[i + 1] > before[i]:
                few = hashes[before[i] : before[i + 1]]
                own, _ = grams(few, np.array([0, len(few)]), len(few))
            yield lo + i, own


def put40(x: np.ndarray) -> bytes:
    """The lowest 40 bits of each value."""
    return (x & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((x >> U(32)) & U(0xFF)).astype(np.uint8).tobytes()


def get40(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32, n, at).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, at + 4 * n).astype(np.uint64) << U(32)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def settle() -> None:
    """Gives memory that is free in this process back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has such a call
        ctypes.CDLL(None).malloc_trim(0)


def batch_rows(out: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


#: Keys of more than one part in so many of the rows, and of more rows than the second number, are heavy.
HEAVY, LEAST_HEAVY = 1000, 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key and in weight how many of left's total rows have it.

    Heavy keys, which by their definition are HEAVY at most, are broadcast; so no task gets more than its part of one key's rows."""
    heavy = F.col(weight) > max(LEAST_HEAVY, total // HEAVY)
    others = [c for c in right.columns if c not in (key, weight)]
    met = left.join(F.broadcast(right.where(heavy).select(key, F.struct(*others).alias("_met"))), key, "left")
    light = right.where(~heavy).select(key, *others)
    known = met.where("_met is not null").select(*left.columns, *(F.col("_met")[c].alias(c) for c in others))
    return known.unionByName(met.where("_met is null").drop("_met").join(light, key, how).select(*left.columns, *others))


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, component) of each node of edges (a, b), most in number if that is known; the component is its smallest node.

    Large-star and small-star turns, written as joins and minima: no group of neighbours is gathered, each turn's edges are at most those before it, and each turn is cut into the shared folder; what the turn before it left there is deleted."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut(pairs if most is None else gathered(pairs, most))
    for _ in range(rounds):
        total = 2 * pairs.count()
        if not total:
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_unique(both.where("b > a"), least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_unique(large, own, "a", "n", total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(gathered(small.where("a <> b").distinct(), total // 2))
        forget(pairs)
        pairs = now
        # Stars only: no node has two centres, and no centre is itself a member.
        if now.groupBy("a").count().where("count > 1").isEmpty() and now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} turns")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def blocks_for(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


#: To how many places one task writes rows of its own. More places than these are reached in two hops.
FAN = 4096
_mail = pa.schema([("to", pa.int32()), ("raw", pa.binary())])


def posted(to: list[int], raws: list[bytes], places: int, fan: int = FAN) -> pa.RecordBatch:
    """Rows (to, raw) for places in ascending order. With more places than fan, a row holds what goes to a range of them, so a task's rows number fan at most and not the places, which grow with the input."""
    if places > fan:
        width, held = math.ceil(places / fan), {}
        for t, raw in zip(to, raws, strict=True):
            held.setdefault(t // width, []).append(struct.pack("<II", t, len(raw)) + raw)
        to, raws = list(held), [b"".join(x) for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(raws, pa.binary())], schema=_mail)


def delivered(mail: DataFrame, places: int, fan: int = FAN, at_once: int = 32 << 20) -> DataFrame:
    """posted() rows as (to, raw) of single places; raw may be several that were posted, one after the other."""
    if places <= fan:
        return mail

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        last, size = None, 0
        for batch in batches:
            for to, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (to != last or size >= at_once):
                    yield posted(list(held), [b"".join(x) for x in held.values()], 1, 1)
                    held, size = {}, 0
                last, size, at = to, size + len(raw), 0
                while at < len(raw):
                    place, n = struct.unpack_from("<II", raw, at)
                    held.setdefault(place, []).append(raw[at + 8 : at + 8 + n])
                    at += 8 + n
        if held:
            yield posted(list(held), [b"".join(x) for x in held.values()], 1, 1)

    return mail.repartition(parts(mail.sparkSession), "to").sortWithinPartitions("to").mapInArrow(dealt, MAIL)


MAIL = "to int, raw binary"
