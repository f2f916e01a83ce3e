"""Operator 13: a quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is compressed with each, in pieces of PIECE bytes,
so that a dictionary helps as much at the end of a long text as at its beginning; the difference of the two sizes for each byte
of text is its raw score. A logistic curve makes it a probability. Beside the difference it knows the smaller size for each byte,
1 at most, since no difference means one thing in a text of a few words and another in one that repeats itself. Its parameters are
fitted to labelled texts by dictionaries that have not seen them (two folds, each scored with the other's dictionaries), weighted
so that the classes have their shares of all labelled rows.

The fit is on a bounded sample: of each class ROWS labelled documents, those of smallest hash of doc_id, and of each of them PIECES
pieces spread evenly over its text; so at most 2 * ROWS * PIECES * PIECE bytes, 16 MB, come to the driver, and the model is some
130 KB. Class shares are counts of all labelled rows. Scores are of whole texts. Only the text is an input of a score.

Nulls: a null text is an empty one; empty texts get the curve's value at no difference and a size of 1. Rows of null doc_id are scored
and never learnt from. Of several labels of a document the worst counts; labels that are null, neither 0 nor 1 or of no
document count for nothing; of several texts of one labelled doc_id the least is learnt from. Without labels of one of
the classes, or without any, the score is the share of good ones, one added to each. Empty documents give no rows. Other columns
are not read."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ROWS, PIECES, PIECE = 1000, 4, 2048
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
PULL = 0.01  # of the curve's parameters to 0
#: Folds of doc_id; rows of fold HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def pieces_of(raw: pa.Buffer | bytes) -> list[memoryview]:
    view = memoryview(raw)
    return [view[i : i + PIECE] for i in range(0, len(view), PIECE)]


def spread(pieces: list, most: int) -> list:
    """At most so many of them, evenly spread, the first and the last among them."""
    return pieces if len(pieces) <= most else [pieces[round(k * (len(pieces) - 1) / (most - 1))] for k in range(most)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, bool]:
    """A dictionary's bytes, and whether zstandard trained it: where there are too few samples for that, they are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(samples)[:size], False


class Model:
    def __init__(self, good: tuple[bytes, bool], bad: tuple[bytes, bool], curve: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.dictionaries, self.curve = (good, bad), curve
        self._press = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_press": None}

    def sizes(self, pieces: list) -> tuple[float, float]:
        """For each byte of a text: how many bytes shorter the good dictionary makes it than the bad one does, and the smaller of the two sizes, 1 at most."""
        if self._press is None:
            kinds = {True: zstandard.DICT_TYPE_FULLDICT, False: zstandard.DICT_TYPE_RAWCONTENT}
            self._press = []
            for raw, trained in self.dictionaries:
                data = zstandard.ZstdCompressionDict(raw, dict_type=kinds[trained]) if raw else None
                if data:
                    data.precompute_compress(level=LEVEL)
                self._press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        total = sum(map(len, pieces))
        if not total:
            return 0.0, 1.0
        good, bad = (sum(len(press.compress(p)) for p in pieces) for press in self._press)
        return (bad - good) / total, min(1.0, good / total, bad / total)

    def score(self, pieces: list) -> float:
        odds = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.sizes(pieces), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, turns: int = 50) -> tuple[float, ...]:
    """Intercept and slopes of the logistic curve of greatest weighted likelihood, by Newton's steps; a slight pull to 0 keeps them finite where a plane parts the classes."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design, beta = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(x.shape[1] + 1)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -50, 50)))
        slope = design.T @ (weight * (y - p)) - PULL * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + PULL * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), *(beta[1:] / scale).tolist()


def learn(samples: list[tuple[int, int, list[bytes]]], counts: dict[int, int]) -> Model:
    """The model of samples (doc_id, quality, pieces); counts are of all labelled rows, by quality."""
    n = {q: sum(s[1] == q for s in samples) for q in (0, 1)}
    if not (n[0] and n[1]):
        good, bad = counts.get(1, 0) + 1, counts.get(0, 0) + 1
        return Model((b"", False), (b"", False), (math.log(good / bad), 0.0, 0.0))
    samples = sorted(samples, key=lambda s: (zlib.crc32(b"fold:%d" % s[0]), s[0]))
    fold = {s[0]: 0 for s in samples}
    for q in (0, 1):  # each class is dealt to the folds in turn
        fold |= {s[0]: k % 2 for k, s in enumerate(s for s in samples if s[1] == q)}

    def built(chosen: list) -> Model:
        return Model(*(dictionary([p for s in chosen if s[1] == q for p in s[2] if len(p)]) for q in (1, 0)))

    halves = [built([s for s in samples if fold[s[0]] == k]) for k in (0, 1)]
    x = np.array([halves[1 - fold[s[0]]].sizes(s[2]) for s in samples])
    y = np.array([s[1] for s in samples], float)
    weight = np.array([counts[s[1]] / n[s[1]] for s in samples])
    whole = built(samples)
    whole.curve = fitted(x, y, weight * len(samples) / weight.sum())
    return whole


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, quality); at most rows documents of each class are learnt from."""
    wanted = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = cut(wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    first = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("sample", pa.list_(pa.binary()))])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[bytes(p) for p in spread(pieces_of(t.as_buffer()), PIECES)] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.binary()))], schema=schema)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(first[0].union(first[1])), "doc_id").select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    drawn = chosen.mapInArrow(samples, "doc_id long, quality int, sample array<binary>").groupBy("doc_id", "quality").agg(F.min("sample").alias("sample"))
    return learn([(r.doc_id, r.quality, [bytes(p) for p in r.sample]) for r in drawn.collect()], counts)  # at most 2 * rows rows of PIECES pieces


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each document: the probability that it is good."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.score(pieces_of(t.as_buffer())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scores, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out (its label is never learnt from), score and predicted of each document."""
    scored = score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
