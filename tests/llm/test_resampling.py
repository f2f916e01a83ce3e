"""Operator 12 against a plain version: whole tables of the smallest size, blocks and shards of a few bytes, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import queries, resampling

from ..conftest import SMALL
from .test_llm import docs, empty, odd  # noqa: F401

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    """rows: (doc_id, text). The contract, word by word."""
    count = [Counter(), Counter()]
    for c, texts in zip(count, ([t for _, t in rows], target), strict=True):
        for t in texts:
            for f in features(t)[1]:
                c[zlib.crc32(f.encode()) % 10000] += 1
    s, t = (sum(c.values()) + 10000 for c in count)
    gain = [math.floor(1000 * math.log((count[1][b] + 1) * s / ((count[0][b] + 1) * t))) for b in range(10000)]
    out, some = [], []
    for doc, text in rows:
        n, own = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in own)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
        if n >= 20:
            some.append(out[-1])
    some.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(some[: 5 * len(some) // 100]):
        r[4] = k + 1
    return out


def same(df, want):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, map(tuple, want)))


def test_op12(spark):
    con = duckdb.connect()
    read = lambda t, key: con.sql(f"select {key}, text from '{SMALL}/{t}.parquet'").fetchall()
    df = queries.op12_importance_resampling(spark, SMALL)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {x for _, x in df.dtypes} == {"bigint"}
    same(df, plain(read("documents", "doc_id"), [t for _, t in read("benchmark", "item_id")]))


@pytest.mark.parametrize("block,shard,fan", [(resampling.BLOCK_BYTES, resampling.SHARD_BYTES, 4096), (300, 3000, 4096), (50, 1000, 4)])
def test_blocks(spark, docs, odd, empty, block, shard, fan):  # noqa: F811
    """Texts cut into pieces, many shards, messages in two hops: the same rows. Null ids, repeated rows, no target, no documents."""
    target = spark.createDataFrame([("Alpha beta alpha BETA é", 1), (None, 2), ("word", 3)], "text string, bucket int")
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        same(resampling.draw(df, target, block=block, shard=shard, fan=fan), plain(rows, [r.text for r in target.collect()]))
    if fan == 4:
        rows = [(r.doc_id, r.text) for r in odd.collect()]
        same(resampling.draw(odd, target.limit(0), block=block, shard=shard), plain(rows, []))
        assert resampling.draw(empty, target, block=block, shard=shard).count() == 0


def test_ties(spark):
    """Equal scores go by doc_id; repeated rows take ranks one after the other."""
    text = "one two three four five " * 5
    rows = [(k % 50, text) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("one two",)], "text string")
    same(resampling.draw(df, target), plain(rows, ["one two"]))


def test_dictionary(spark, docs):  # noqa: F811
    target = spark.createDataFrame([("abc de abc de",)], "text string")
    want, other = Counter(), Counter(features("abc de abc de")[1])
    for r in docs.collect():
        want.update(features(r.text)[1])
    got = resampling.dictionary(docs, target, block=2000, shard=5000).collect()
    assert len(got) == len({r.feature for r in got}) == len(want | other)
    assert all((r.n, r.n_target, r.bucket) == (want[r.feature], other[r.feature], zlib.crc32(r.feature.encode()) % 10000) for r in got)


def test_more_words_than_numbers(monkeypatch):
    """A block with more distinct words than a key has room for is cut in two, again and again."""
    r = random.Random(4)
    texts = [" ".join(str(r.randrange(200)) for _ in range(r.randint(0, 90))) for _ in range(20)]
    monkeypatch.setattr(resampling, "BITS", 4)
    got = Counter()
    for words in resampling.pieces(pa.array(texts), 400):
        for book, numbers, counts in resampling._distinct(words):
            own = book.to_pylist()
            for *ids, n in zip(*numbers, counts, strict=True):
                got[b" ".join(own[i] for i in ids).decode()] += int(n)
    assert got == sum((Counter(features(t)[1]) for t in texts), Counter())


def test_moved():
    r = random.Random(6)
    for _ in range(50):
        a, b = (r.randbytes(r.choice([0, 1, 5, 63, 64, 65, 400])) for _ in range(2))
        assert resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_rows_sent_in_proportion(spark):
    """What goes to the dictionary from twice the texts is at most twice as much, hot texts or not."""
    r = random.Random(3)
    say = lambda n: " ".join(str(r.randrange(500)) for _ in range(n))
    hot, sent = say(60), []
    for n in (200, 400):
        df = spark.createDataFrame([(k, hot if k % 3 == 0 else say(60)) for k in range(n)], "doc_id long, text string").coalesce(1)
        rows = resampling._sent(df, df.limit(0), 20_000, 40_000, 4096).collect()
        sent.append(sum(len(x.raw) for x in rows))
    assert sent[1] <= 2.1 * sent[0]
