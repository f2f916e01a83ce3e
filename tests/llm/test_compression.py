"""Operator 13: held-out accuracy, what it must not look at, a plain version of its scores, odd tables."""

import math
import random
import zlib

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from corvane.llm import compression, queries

from ..conftest import SMALL
from .test_llm import docs, empty, odd  # noqa: F401

LARGER = SMALL.replace("0.001", "0.01")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def made(n, seed=1):
    """Texts that are prose (quality 1), or that have symbols behind their words or repeat one word (0), with rows (doc_id, text) and (doc_id, quality)."""
    r, texts, labels = random.Random(seed), [], []
    book = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(400)]
    for k in range(n):
        w = r.choices(book, k=r.randint(30, 900))
        good = k % 3 > 0
        texts.append((k, " ".join(w) if good else " ".join(x + r.choice(("###", "&&&", "$$$")) for x in w) if k % 2 else f"{w[0]} " * len(w)))
        labels.append((k, int(good)))
    return texts, labels


def test_op13(spark):
    """Registered query at 1000 documents: fold, range, and labels that it has not learnt from."""
    df = queries.op13_quality_classifier(spark, LARGER)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in df.collect()}
    con = duckdb.connect()
    assert len(rows) == con.sql(f"select count(*) from '{LARGER}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (fold(k) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in rows.items())
    held = [(rows[k], q) for k, q in con.sql(f"select doc_id, quality from '{LARGER}/labels.parquet'").fetchall() if rows[k].held_out]
    good, bad = ([r.score for r, q in held if q == x] for x in (1, 0))
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_scores_are_those_of_the_sizes(spark, docs):  # noqa: F811
    texts, labels = made(300)
    model = compression.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in compression.score(docs, model).collect()}
    for r in docs.collect():
        raw, sizes = (r.text or "").encode(), []
        for data, trained in model.dictionaries:
            assert trained
            press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(press.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
        a, b, c = model.curve
        odds = a + b * (sizes[1] - sizes[0]) / len(raw) + c * min(1, min(sizes) / len(raw)) if raw else a + c
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_held_out(spark):
    """Accuracy on texts that the model has not seen, good short and empty ones among them, and scores that are probabilities."""
    texts, labels = made(600)
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = [(r, labels[r.doc_id][1]) for r in compression.classify(df, known).collect() if r.held_out]
    assert sum(r.predicted == q for r, q in rows) / len(rows) > 0.97
    assert abs(sum(r.score for r, _ in rows) / len(rows) - sum(q for _, q in rows) / len(rows)) < 0.05
    short = compression.score(spark.createDataFrame([(1, ""), (2, None), (3, "the"), (4, texts[1][1][:40])], "doc_id long, text string"), compression.fit(df, known))
    assert all(r.score > 0.5 for r in short.collect())


def test_only_the_text_of_allowed_rows(spark):
    """Held-out labels, order, partitions, other columns and the doc_id of what is scored change nothing."""
    texts, labels = made(240)
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    want = {r.doc_id: r.score for r in compression.classify(df, known).collect()}
    turned = known.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    more = df.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "quality": F.lit(0), "score": F.lit(0.0)}).repartition(5, "text")
    assert {r.doc_id: r.score for r in compression.classify(more, turned.repartition(3)).collect()} == want
    model = compression.fit(df, known)
    moved = compression.score(df.withColumn("doc_id", F.col("doc_id") + 100000), model)
    assert {r.doc_id - 100000: r.score for r in moved.collect()} == want


def test_bounded_sample(spark, monkeypatch):
    """So many rows of a class are learnt from, whatever the tables' size, whole texts being spread over pieces; class shares are of all."""
    texts, labels = made(300)
    texts = [(k, t * 40) for k, t in texts]
    seen = {}
    monkeypatch.setattr(compression, "learn", lambda samples, counts: seen.update(samples=samples, counts=counts))
    compression.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), rows=20)
    allowed = [(k, q) for k, q in labels if fold(k) != 1]
    assert seen["counts"] == {q: sum(x == q for _, x in allowed) for q in (0, 1)}
    assert [sum(s[1] == q for s in seen["samples"]) for q in (0, 1)] == [20, 20]
    for doc, _, pieces in seen["samples"]:
        raw = texts[doc][1].encode()
        assert fold(doc) != 1 and len(pieces) <= compression.PIECES and raw.startswith(pieces[0]) and raw.endswith(pieces[-1])


def test_odd_tables(spark, docs, odd, empty):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(None, 1), (5, 0), (5, 1), (5, None), (9, 1), (9, 7), (777, 0)], "doc_id long, quality int")
    assert compression.classify(empty, labels).count() == 0 == compression.classify(empty, none).count()
    assert {r.score for r in compression.classify(docs, none).collect()} == {0.5}
    rows = compression.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    one = compression.classify(docs, spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")).collect()
    known = sum(fold(k) != 1 for k in range(30))
    assert {round(r.score, 12) for r in one} == {round((known + 1) / (known + 2), 12)}
    few = compression.classify(docs, spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")).collect()
    assert len(few) == docs.count() and all(0 <= r.score <= 1 for r in few)


def test_repeated_labelled_text(spark):
    """A labelled doc_id that a third of all rows has is one sample."""
    texts, labels = made(90)
    hot = next(k for k, _ in labels if fold(k) != 1)
    df = spark.createDataFrame(texts + [(hot, f"{i} text")[:2] for i in range(50)], "doc_id long, text string")
    assert compression.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 140
