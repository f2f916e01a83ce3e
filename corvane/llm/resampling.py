"""Operator 12: resampling by importance towards the distribution of target texts, with a dictionary of distinct features.

Features are runs of one to three words. A block of texts counts its own distinct features, by exact keys of word numbers, and
sends them, each once with its count, to the dictionary's shards by a hash of their words. A shard counts strings over all
blocks, hashes each distinct string once into its bucket, and gives the sums of its buckets. The gains of the 10000 buckets
come from these sums, so they are a list of bounded size, and go back to documents, whose features find their buckets again:
a run's crc32 follows from those of its words (crc32 of a + b is that of a, moved by b's length, xor that of b), so only the
distinct words of a block are hashed then. Texts are read three times (their size, dictionary, weights) and never shuffled.

Documents are drawn without replacement by weight plus Gumbel noise from a hash of doc_id: the highest scores win. They are numbered
over all tasks of a sort by ranges.

Nulls: a null text has no words; rows without words have weight 0. Rows with a null or repeated doc_id are counted, scored and drawn
like others (a null id is hashed as an empty string and comes last among equal scores; equal rows take ranks one after the
other). With an empty target its counts are 0. Empty documents give no rows. Other columns are not read."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FAN, MAIL, WORD_BYTE, U, blocks_for, chunks, cut, delivered, mix, parts, posted, runs, settle, text_bytes, word_places

BUCKETS, ADD = 10_000, 1
#: Bytes of the texts of one block, and of those whose features a shard of the dictionary gets.
BLOCK_BYTES, SHARD_BYTES = 12 << 20, 8 << 20
#: Buckets whose sums are one row.
PART = 40
#: Strings that a block makes, and a shard hashes, at once.
AT_ONCE = 1 << 18
#: Tasks whose offsets (16 bytes each) are broadcast; more of them meet the rows in a join.
TASKS = 1 << 16
BITS = 21  # of a word's number in a feature's key; blocks with more distinct words are cut in two


class Words:
    """The words of some texts, A-Z as a-z: their numbers, the row of each, which are the piece's own, and the distinct words themselves."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, own: np.ndarray, book: pa.Array):
        self.ids, self.row, self.own, self.book = ids, row, own, book

    def runs(self, n: int) -> np.ndarray:
        """Where runs of n words begin whose last word is the piece's own."""
        m = max(0, len(self.ids) - n + 1)
        return np.flatnonzero((self.row[:m] == self.row[n - 1 :]) & self.own[n - 1 :]) if m else np.zeros(0, np.int64)

    def halves(self) -> list[Words]:
        mid, out = len(self.ids) // 2, []
        for lo, hi, first in ((0, mid, 0), (max(0, mid - 2), len(self.ids), mid)):
            own = self.own[lo:hi].copy()
            own[: first - lo] = False
            kept, ids = np.unique(self.ids[lo:hi], return_inverse=True)
            out.append(Words(ids, self.row[lo:hi], own, self.book.take(pa.array(kept))))
        return out


def _until(data: np.ndarray, at: int) -> int:
    """The first place from at on that is in no word, or the end."""
    while at < len(data):
        gap = np.flatnonzero(~WORD_BYTE[data[at : at + 4096]])
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return len(data)


def pieces(texts: pa.Array, limit: int) -> Iterator[Words]:
    """The words of the texts in pieces of about limit bytes. A longer text is cut between words, and a piece begins with the two words before it, which are not its own."""
    for lo, hi, data, offs in chunks(texts, limit):
        since = at = 0
        while at < len(data):
            whole = hi - lo > 1 or len(data) - at <= limit
            to = len(data) if whole else _until(data, at + limit)
            part = data[since:to]
            folded = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
            start, end, before = word_places(folded, offs if hi - lo > 1 else np.array([0, len(part)]))
            if len(start):
                inside = np.zeros(len(part) + 1, np.int8)
                inside[start] += 1
                inside[end] -= 1
                packed = folded[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
                offsets = np.concatenate(([0], np.cumsum(end - start)))
                coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
                yield Words(coded.indices.to_numpy(), np.repeat(np.arange(lo, hi, dtype=np.int32), np.diff(before)), start >= at - since, coded.dictionary)
                since += int(start[-2:][0])
            else:
                since = to
            at = to


def _ended(book: pa.Array) -> pa.Array:
    """The strings, each ended by a line feed, which no word has."""
    return pc.binary_join_element_wise(book, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))


def _listed(ended: pa.Array) -> list[bytes]:
    """Strings that are ended by a line feed, without it."""
    if not len(ended):
        return []
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return bytes(memoryview(ended.buffers()[2])[offsets[0] : offsets[-1] - 1]).split(b"\n")


def _distinct(words: Words) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """(distinct words, the words of each distinct feature by their numbers, how often it stands there), by length of features."""
    if len(words.book) + 1 >= 1 << BITS:
        for half in words.halves():
            yield from _distinct(half)
        return
    for n in (1, 2, 3):
        at = words.runs(n)
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = key << U(BITS) | words.ids[at + k].astype(np.uint64)
        key.sort()
        begin = runs(key)
        mask = U((1 << BITS) - 1)
        yield words.book, [(key[begin] >> U(BITS * (n - 1 - k)) & mask).astype(np.int32) for k in range(n)], np.diff(np.append(begin, len(key)))


def _mail(words: Words, shards: int, target: bool, fan: int) -> Iterator[pa.RecordBatch]:
    """A block's features as messages to the shards, by length of features: strings, each ended by a line feed, and counts. Strings are made for AT_ONCE of them, or one shard's, at a time."""
    press, binary = zstandard.ZstdCompressor(level=5), pa.large_binary()
    for book, numbers, counts in _distinct(words):
        held: dict[int, list[bytes]] = {}
        ended = _ended(book)
        hashes = np.array([zlib.crc32(w) for w in _listed(ended)], np.uint32)
        told = np.zeros(len(counts), np.uint64)
        for x in numbers:
            told = mix(told + hashes[x] + U(1))
        shard = (told % U(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int32)
        del told, hashes
        order = np.argsort(shard, kind="stable")
        shard, begin = shard[order], runs(shard[order])
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + AT_ONCE)) - 1)
            lo, hi = int(begin[at]), int(begin[to]) if to < len(begin) else len(shard)
            some = order[lo:hi]
            own = [(ended if k == len(numbers) - 1 else book).take(pa.array(x[some])) for k, x in enumerate(numbers)]
            strings = pc.binary_join_element_wise(*own, pa.scalar(b" ", binary)) if len(own) > 1 else own[0]
            offsets, data = np.frombuffer(strings.buffers()[1], np.int64), memoryview(strings.buffers()[2])
            for a, b in zip((begin[at:to] - lo).tolist(), [*(begin[at + 1 : to] - lo).tolist(), hi - lo], strict=True):
                n = counts[some[a:b]]
                texts, numbers_of = press.compress(data[offsets[a] : offsets[b]]), press.compress(n.astype("<u8" if int(n.max()) >> 32 else "<u4").tobytes())
                held.setdefault(int(shard[lo + a]), []).append(struct.pack("<IIIB", b - a, len(texts), len(numbers_of), target) + texts + numbers_of)
            at = to
        if held:
            yield posted(sorted(held), [b"".join(held[t]) for t in sorted(held)], shards, fan)


def _counted(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A shard's distinct features, each ended by a line feed, and how often documents and target texts have them."""
    unpress, strings, counts, targets = zstandard.ZstdDecompressor(), [], [], []
    for raw in table.column("raw").to_pylist():
        at = 0
        while at < len(raw):
            n, size, more, target = struct.unpack_from("<IIIB", raw, at)
            at += 13
            strings.append(unpress.decompress(raw[at : at + size]))
            numbers = unpress.decompress(raw[at + size : at + size + more])
            counts.append(np.frombuffer(numbers, "<u4" if len(numbers) == 4 * n else "<u8").astype(np.int64))
            targets.append(np.full(n, target, bool))
            at += size + more
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ids, count, target = coded.indices.to_numpy(), np.concatenate(counts), np.concatenate(targets)
    n, t = (np.zeros(len(coded.dictionary), np.int64) for _ in range(2))
    np.add.at(n, ids[~target], count[~target])
    np.add.at(t, ids[target], count[target])
    return coded.dictionary, n, t


def _buckets(features: pa.Array, buckets: int) -> np.ndarray:
    """Each distinct string is hashed here, once."""
    out = np.zeros(len(features), np.int64)
    for at in range(0, len(features), AT_ONCE):
        out[at : at + AT_ONCE] = [zlib.crc32(x) for x in _listed(features.slice(at, AT_ONCE))]
    return out % buckets


def _sent(docs: DataFrame, target: DataFrame, block: int, shard: int, fan: int) -> DataFrame:
    shards = max(parts(docs.sparkSession), blocks_for(text_bytes(docs) + text_bytes(target), shard))

    def features(of_target: bool):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Array] = []
            size = 0

            def done() -> Iterator[pa.RecordBatch]:
                nonlocal held, size
                texts, held, size = pa.concat_arrays(held), [], 0
                for words in pieces(texts, block + block // 4):
                    yield from _mail(words, shards, of_target, fan)
                settle()

            for batch in batches:
                texts = batch.column(0)
                at = 0
                while at < len(texts):  # whole batches may be larger than a block
                    some = texts.slice(at, 512)
                    at += 512
                    held.append(some)
                    size += some.nbytes
                    if size >= block:
                        yield from done()
            if held:
                yield from done()

        return blocks

    sent = [df.select("text").mapInArrow(features(mark), MAIL) for df, mark in ((docs, False), (target, True))]
    return delivered(sent[0].union(sent[1]), shards, fan)


def dictionary(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block: int = BLOCK_BYTES, shard: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """(feature, n, n_target, bucket) of each distinct feature of the texts of docs and target."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64()), ("n_target", pa.int64()), ("bucket", pa.int64())])

    def rows(table: pa.Table) -> pa.Table:
        features, n, t = _counted(table)
        plain = pc.binary_slice(features.cast(pa.binary()), 0, -1).cast(pa.string())
        return pa.Table.from_arrays([plain, pa.array(n), pa.array(t), pa.array(_buckets(features, buckets))], schema=schema)

    return _sent(docs, target, block, shard, fan).groupBy("to").applyInArrow(rows, "feature string, n long, n_target long, bucket long")


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block: int = BLOCK_BYTES, shard: int = SHARD_BYTES, fan: int = FAN) -> list[int]:
    """The gain of each bucket, in thousandths of a nat: how much likelier it is in target than in docs, one added to each count."""
    schema = pa.schema([("part", pa.int32()), ("sums", pa.list_(pa.int64()))])
    wide = math.ceil(buckets / PART) * PART

    def sums(table: pa.Table) -> pa.Table:
        features, n, t = _counted(table)
        bucket = _buckets(features, buckets)
        both = np.zeros((2, wide), np.int64)
        for total, count in zip(both, (n, t), strict=True):
            np.add.at(total, bucket, count)
        del features, bucket, n, t
        settle()
        rows = both.reshape(2, -1, PART).transpose(1, 0, 2).reshape(-1, 2 * PART)
        return pa.Table.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(list(rows), pa.list_(pa.int64()))], schema=schema)

    # A shard gives a row for PART buckets; tasks add their shards' rows up before they are shuffled.
    shards = _sent(docs, target, block, shard, fan).groupBy("to").applyInArrow(sums, "part int, sums array<long>")
    n, t = [0] * wide, [0] * wide
    for part, *totals in shards.groupBy("part").agg(*(F.sum(F.col("sums")[k]) for k in range(2 * PART))).collect():  # wide / PART rows
        n[part * PART : (part + 1) * PART], t[part * PART : (part + 1) * PART] = totals[:PART], totals[PART:]
    n, t = n[:buckets], t[:buckets]
    of_docs, of_target = sum(n) + ADD * buckets, sum(t) + ADD * buckets
    return [math.floor(1000 * math.log((b + ADD) * of_docs / ((a + ADD) * of_target))) for a, b in zip(n, t, strict=True)]


def _shifts(longest: int = 64) -> np.ndarray:
    """shifts[n, k, b]: what byte k with value b of a crc32 gives once n bytes more are read, for n up to longest."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)  # fixed value: the reversed polynomial of crc32
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = out[n] >> 8 ^ one[out[n] & 255]
    return out


_shift = _shifts()


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 values, moved by n bytes."""
    crc, left = crc.copy(), n.copy()
    some, most = np.arange(len(crc)), len(_shift) - 1
    while len(some):
        by, now = np.minimum(left[some], most), crc[some]
        crc[some] = np.bitwise_xor.reduce([_shift[by, k, now >> 8 * k & 255] for k in range(4)])
        left[some] -= by
        some = some[left[some] > 0]
    return crc


def weigh(docs: DataFrame, gain: list[int], block: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: weight is the sum of the gains of its features' buckets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            out = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for words in pieces(batch.column(1), block):
                book = _listed(_ended(words.book))
                alone, after = (np.array([zlib.crc32(p + w) for w in book], np.uint32) for p in (b"", b" "))
                size = np.array([len(w) + 1 for w in book], np.int64)
                crc = alone[words.ids]
                for n in (1, 2, 3):
                    at = words.runs(n)
                    if n > 1:
                        every = words.ids[n - 1 :]  # those over the ends of texts are made too, and not taken
                        crc = moved(crc[: len(every)], size[every]) ^ after[every]
                    row = words.row[at]
                    first = runs(row)
                    if len(first):
                        out[2][row[first]] += np.add.reduceat(table[crc[at] % len(table)], first)
                        out[1][row[first]] += np.diff(np.append(first, len(row)))
                        if n == 1:
                            out[0][row[first]] += np.diff(np.append(first, len(row)))
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """df, cut, with rank: 1, 2, 3 ... in the order given, over all tasks. One row for each task meets in a window."""
    spark, names = df.sparkSession, df.columns
    sorted_ = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(before, before + batch.num_rows, dtype=np.int64))
            before += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), at], names=[*names, "_task", "_at"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    made = cut(sorted_.mapInArrow(placed, f"{types}, _task int, _at long"))
    tasks = made.groupBy("_task").agg(F.count("*").alias("n"))
    first = tasks.select("_task", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return made.join(F.broadcast(first) if parts(spark) <= TASKS else first, "_task").select(*names, (F.col("first") + F.col("_at") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: str = "42", buckets: int = BUCKETS, block: int = BLOCK_BYTES, shard: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document; rank is null for those that are not drawn."""
    weighed = weigh(docs, gains(docs, target, buckets, block, shard, fan), block)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise).select("doc_id", "n_words", "n_features", "weight", "score"))
    some = F.col("n_words") >= least_words
    ranked = numbered(scored.where(some), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    drawn = percent * scored.where(some).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(scored.where(~some).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")
