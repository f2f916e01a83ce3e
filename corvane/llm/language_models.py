"""Operator 6: cross-entropy difference of two matched n-gram models.

The target model counts the words and word pairs of the target documents, the background model those of all documents. Both
have one vocabulary, the words that all documents have twice or more, and one smoothing; a document's score is the mean, over
its words, of the background's loss less the target's.

Neither model is gathered anywhere. Documents are dealt to batches by a hash of doc_id, each batch sends the distinct words and
pairs that it has, packed by bucket, with its counts; a bucket sums these and sends each batch the sums that it asked for, in
the order of its question. So counts are those of all documents, equal words of a batch travel once, and a frequent word
costs a bucket one entry for each batch. Rows that are sent number the input by a constant: from some number of buckets
or batches on, they travel in two hops (common.posted). A bucket knows a key by 40 bits: two of a bucket's n keys meet with a
chance of n * n / 2**41, so of buckets with a million keys every second has such a pair, and both get the sum of their counts. The models' totals, five numbers, come from a sum over buckets.

Nulls: a null text has no words; documents without words have n_words 0 and null losses; rows with a null or repeated
doc_id are counted and scored like others (a null id is no target). Labels of no document, or null ones, count for nothing;
of several labels of a document one that is good is enough. Empty tables give empty results. Other columns are not read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FAN, MAIL, U, blocks_for, chunks, delivered, get40, grams, parts, posted, put40, text_bytes, words
from .substrings import batch_of

BATCH_BYTES, BUCKET_BYTES = 16 << 20, 16 << 20
KNOWN, ADD, PRIOR = 2, 0.5, 4.0  # least count of a word of the vocabulary; what is added to a word's count; weight of words against pairs
LOW = U((1 << 40) - 1)
SUMS = MAIL + ", heads array<long>"
_sums = pa.schema([("to", pa.int32()), ("raw", pa.binary()), ("heads", pa.list_(pa.int64()))])


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, their rows, pair hashes, their rows). Words and pairs differ in their lowest bit."""
    for lo, hi, data, offs in chunks(texts):
        hashes, before = words(data, offs)
        pairs, pair_row = grams(hashes, before, 2)
        yield lo, hi - lo, hashes | U(1), np.repeat(np.arange(hi - lo), np.diff(before)), pairs & ~U(1), pair_row


def _question(docs: pa.Table, buckets: int, targets: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's distinct hashes in order of bucket and hash, and how often all and target documents have each."""
    ids = docs.column("doc_id").to_pylist()
    chosen = np.array([i in targets for i in ids], bool)
    keys, marks = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for lo, n, w, w_row, p, p_row in _grams(docs.column("text")):
        own = chosen[lo : lo + n]
        keys += [w, p]
        marks += [own[w_row], own[p_row]]
    key, mark = np.concatenate(keys), np.concatenate(marks)
    order = np.argsort(key, kind="stable")
    key, mark = key[order], mark[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(key)))
    hits = np.add.reduceat(mark.astype(np.int64), begin) if len(key) else n
    key = key[begin]
    order = np.lexsort((key & LOW, (key >> U(40)) % U(buckets)))
    return key[order], n[order], hits[order]


def _numbers(x: np.ndarray) -> bytes:
    raw = zlib.compress(x.astype("<u4" if not len(x) or x.max() < 1 << 32 else "<u8").tobytes(), 1)
    return len(raw).to_bytes(4, "little") + raw


def _read(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = int.from_bytes(raw[at : at + 4], "little")
    got = zlib.decompress(raw[at + 4 : at + 4 + size])
    return np.frombuffer(got, "<u4" if len(got) == 4 * n else "<u8").astype(np.int64), at + 4 + size


def score(docs: DataFrame, targets: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) of each document (doc_id, text); targets (doc_id) are those that the target model is made of. Losses are nats for a word; score is the second less the first."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    batches, buckets = blocks_for(size, batch_bytes), max(parts(spark), blocks_for(size, bucket_bytes))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("batch", batch_of(F.col("doc_id"), batches))
    chosen = targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().withColumn("batch", batch_of(F.col("doc_id"), batches))

    def ask(table: pa.Table, good: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([posted([], [], buckets, fan)])
        key, n, hits = _question(table, buckets, set(good.column("doc_id").to_pylist()))
        bucket = ((key >> U(40)) % U(buckets)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(key) else np.zeros(0, np.int64)
        own = table.column("batch")[0].as_py()
        raws = [struct.pack("<II", own, b - a) + put40(key[a:b]) + _numbers(n[a:b]) + _numbers(hits[a:b]) for a, b in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist(), strict=True)] if len(key) else []
        return pa.Table.from_batches([posted(bucket[begin].tolist(), raws, buckets, fan)])

    def sums(table: pa.Table) -> pa.Table:
        bucket = table.column("to")[0].as_py()
        askers, keys, counts, hits = [], [], [], []
        for raw in table.column("raw").to_pylist():
            at = 0
            while at < len(raw):
                asker, n = struct.unpack_from("<II", raw, at)
                askers.append(asker)
                keys.append(get40(raw, at + 8, n))
                x, at = _read(raw, at + 8 + 5 * n, n)
                y, at = _read(raw, at, n)
                counts.append(x)
                hits.append(y)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
        group = np.empty(len(every), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(every))))
        total = np.bincount(group, np.concatenate(counts), len(begin)).astype(np.int64)
        target = np.bincount(group, np.concatenate(hits), len(begin)).astype(np.int64)
        word = (every[order][begin] & U(1)).astype(bool)
        known = word & (total >= KNOWN)
        heads = [int(x) for x in (known.sum(), total[word].sum(), target[word].sum(), total[known].sum(), target[known].sum())]
        raws, at = [], 0
        for k in keys:
            own = group[at : at + len(k)]
            at += len(k)
            raws.append(struct.pack("<II", bucket, len(k)) + _numbers(total[own]) + _numbers(target[own]))
        mail = posted(askers, raws, batches, fan)
        to, raws = mail.column(0).to_pylist(), mail.column(1).to_pylist()
        return pa.Table.from_arrays([pa.array([*to, None], pa.int32()), pa.array([*raws, None], pa.binary()), pa.array([None] * len(to) + [heads], pa.list_(pa.int64()))], schema=_sums)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])

    def judge(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        key, *_ = _question(table, buckets, set())
        bucket = ((key >> U(40)) % U(buckets)).astype(np.int64)
        total, target = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for raw in told.column("raw").to_pylist():
            at = 0
            while at < len(raw):
                b, n = struct.unpack_from("<II", raw, at)
                lo = int(np.searchsorted(bucket, b))
                total[lo : lo + n], at = _read(raw, at + 8, n)
                target[lo : lo + n], at = _read(raw, at, n)
        vocabulary, n_total, n_target, in_total, in_target = told.column("totals")[0].as_py() if told.num_rows else (0,) * 5
        order = np.argsort(key)
        key, counts = key[order], np.stack([target[order], total[order]]).astype(float)
        known = total[order] >= KNOWN
        sizes, unknown = np.array([[n_target], [n_total]], float), np.array([[n_target - in_target], [n_total - in_total]], float)
        ids, out = table.column("doc_id").to_pylist(), []
        for lo, n, w, w_row, p, p_row in _grams(table.column("text")):
            at_word = np.searchsorted(key, w)
            count = np.where(known[at_word], counts[:, at_word], unknown)
            unigram = (count + ADD) / (sizes + ADD * (vocabulary + 1))
            losses = -np.log(unigram)
            if len(p):
                # The second word of each pair follows the first in the same row.
                second = np.flatnonzero(w_row[1:] == w_row[:-1]) + 1
                both = known[at_word[second]] & known[at_word[second - 1]]
                pair = np.where(both, counts[:, np.searchsorted(key, p)], 0.0)
                history = np.where(both, counts[:, at_word[second - 1]], 0.0)
                losses[:, second] = -np.log((pair + PRIOR * unigram[:, second]) / (history + PRIOR))
            number = np.bincount(w_row, minlength=n)
            means = [np.bincount(w_row, x, n) / np.maximum(number, 1) for x in losses]
            out += [(ids[lo + i], int(number[i]), *((float(means[0][i]), float(means[1][i]), float(means[1][i] - means[0][i])) if number[i] else (None, None, None))) for i in range(n)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), out_schema, strict=True)], schema=out_schema)

    asked = delivered(dealt.groupBy("batch").cogroup(chosen.groupBy("batch")).applyInArrow(ask, MAIL), buckets, fan)
    summed = asked.groupBy("to").applyInArrow(sums, SUMS)
    # One row of five sums goes to each batch with its mail; all in one plan, so texts and questions are shuffled once.
    totals = summed.agg(F.array(*(F.coalesce(F.sum(F.col("heads")[k]), F.lit(0)) for k in range(5))).alias("totals"))
    told = delivered(summed.where("heads is null").select("to", "raw"), batches, fan).crossJoin(F.broadcast(totals))
    return dealt.groupBy("batch").cogroup(told.groupBy("to")).applyInArrow(judge, "doc_id long, n_words long, target_loss double, background_loss double, score double")
