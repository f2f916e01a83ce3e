"""Feature-hash embeddings and vector arithmetic, with built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FNV-1a of 32 bits, and the embedding's dimension.
FNV_START, FNV_PRIME, DIMENSION = 2166136261, 16777619, 256


def fnv1a(word: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    bytes_of = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.conv(F.substring(F.hex(F.encode(word, "utf-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(bytes_of, F.lit(FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def hashed_weights(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, bucket, weight): the sparse embedding of each row's tokens, of length 1. Each distinct token is hashed once."""
    spread = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").count()
    book = spread.select("token").distinct().withColumn("h", fnv1a(F.col("token")))
    sign = F.when(F.col("h").bitwiseAND(F.lit(65536).cast("long")) != 0, F.lit(1)).otherwise(F.lit(-1))
    summed = spread.join(book, "token").groupBy(key, (F.col("h") % DIMENSION).cast("int").alias("bucket")).agg(F.sum(sign * F.col("count")).cast("double").alias("w")).where("w <> 0")
    length = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return summed.join(length, key).select(key, "bucket", (F.col("w") / F.col("length")).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    """The dot product, 0 for unlike lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    # The length is an array's one element, so it is computed once and not for each of v's.
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n)))[0]


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def round4(w: Column) -> Column:
    """Half is added at the fourth place and the rest cut off towards 0."""
    return (w * 1e4 + 0.5).cast("bigint") / 1e4


def encoded(v: Column) -> Column:
    """Vectors as little-endian floats of four bytes."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(v)


def decoded(raw: Column) -> Column:
    """The vectors of such bytes; what is left behind the last four is dropped."""

    @F.pandas_udf("array<float>")
    def unpacked(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.frombuffer(x, "<f4", len(x) // 4))

    return unpacked(raw)


def encode(v: list[float]) -> bytes:
    import struct

    return struct.pack(f"<{len(v)}f", *v)


def decode(raw: bytes) -> list[float]:
    import struct

    return list(struct.unpack(f"<{len(raw) // 4}f", raw[: len(raw) // 4 * 4]))


#: Products of vectors that are looked at at once.
PRODUCTS = 1 << 20


class Stack:
    """A task's vectors, an Arrow column of lists without null elements, as a matrix for each length."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(self.sizes) - self.sizes
        lengths = np.unique(self.sizes)
        if len(lengths) == 1 and lengths[0]:
            self.parts = {int(lengths[0]): (np.arange(len(self.sizes)), flat.reshape(-1, lengths[0]))}
        else:
            self.parts = {int(n): (at := np.flatnonzero(self.sizes == n), flat[starts[at][:, None] + np.arange(n)]) for n in lengths if n}
        self._halves: dict[int, np.ndarray] = {}
        self._columns: dict[int, np.ndarray] = {}

    def halves(self, n: int) -> np.ndarray:
        """The matrix of length n in 32-bit floats; made once, as one stack may meet many."""
        if n not in self._halves:
            self._halves[n] = self.parts[n][1].astype("f4")
        return self._halves[n]

    def columns(self, n: int) -> np.ndarray:
        """Its transpose, each row together in memory; made once."""
        if n not in self._columns:
            self._columns[n] = np.ascontiguousarray(self.parts[n][1].T)
        return self._columns[n]


def close(one: Stack, two: Stack, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dot): pairs of one's and two's vectors whose dot() is least[i] or more; NaN counts as more than any number, as in Spark.

    Products of matrices of 32-bit floats, which are off by less than is allowed for vectors of length 1, leave few pairs. Those are summed in dot()'s order, so equal vectors have equal dots wherever they stand."""
    for n in one.parts.keys() & two.parts.keys():
        left, right = one.parts[n][0], two.parts[n][0]
        low, a32, b32 = (least[left] - (n + 8) * 2.0**-22)[:, None].astype("f4"), one.halves(n), two.halves(n).T
        a, b, step = one.columns(n), two.columns(n), max(1, PRODUCTS // len(right))
        for k in range(0, len(left), step):
            with np.errstate(all="ignore"):
                under = a32[k : k + step] @ b32 < low[k : k + step]
                # One flat search: that of two dimensions takes longer than the product.
                i, j = np.divmod(np.flatnonzero(np.logical_not(under, out=under)), len(right))
                i += k
                exact = a[0][i] * b[0][j]
                for x, y in zip(a[1:], b[1:], strict=True):
                    exact += x[i] * y[j]
                keep = ~(exact < least[left[i]])
            yield left[i[keep]], right[j[keep]], exact[keep]
    if set(one.sizes) | set(two.sizes) != set(one.parts) or len(one.parts) > 1:  # unlike lengths have dot 0
        for i in np.flatnonzero(least <= 0):
            j = np.flatnonzero((two.sizes != one.sizes[i]) | (one.sizes[i] == 0))
            yield np.full(len(j), i), j, np.zeros(len(j))


def complete(v: Column) -> Column:
    """Whether no element is null; a vector with one has no dot with others."""
    return ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False))


def incomplete(column: pa.Array) -> np.ndarray:
    """The places of an Arrow column's lists that are not complete()."""
    return np.unique(pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[column.flatten().is_null().to_numpy(zero_copy_only=False)])
