"""Operator 2: hierarchical multi-length packing.

A document's ids are cut into full windows of the longest tier; what remains is routed to the smallest tier that holds it.
Each tier is packed into windows of its own length: a window begins with a piece of its tier, its gap is filled with the
longest fitting pieces of shorter tiers, and what gap is left by the head of a piece, cut there. So windows are full,
and being powers of two they need no padding. What no window holds in the end goes to windows of powers of two down to 1.
Windows of one tier are numbered over all tasks and make step groups of equal numbers of tokens; only a tier's last group
may be short.

Tasks pack their own documents by themselves, in bounded blocks: texts and ids are not shuffled. A sequence's id has the
task's partition in its upper bits, so input that is a scan of files (or comes in a fixed order otherwise) gives the same
packing again when a lost task is repeated. The pieces are cut into the shared folder, and a row for each task and tier
gives the numbers of its first windows.

Nulls: a null text is an empty one, which has the end id alone; rows with null or repeated doc_id are packed like others.
An empty table gives no rows. Other columns of the input are not read."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, settle
from .tokens import encoder

TIERS = (2048, 1024, 512, 256)
#: Ids of one step group, and ids that a task holds before it packs them.
STEP_IDS, BLOCK_IDS = 16 * 2048, 1 << 21
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "number")
PIECES = ", ".join(f"{c} long" for c in COLUMNS)
_schema = pa.schema([(c, pa.int64()) for c in COLUMNS])
#: Bits of a sequence's id that number it within its task.
TASK = 36


class Packer:
    """add() documents, take rows; end() gives the rest. A piece is (length, serial, doc_id, start, doc_tokens, ids)."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next, self.base, self.serial, self.held = tiers, 0, base, 0, 0
        self.pool: list[tuple] = []
        self.rows: list[list[int]] = [[] for _ in _schema]
        self.made = dict.fromkeys(tiers, 0)  # windows of each tier

    def add(self, doc: int | None, ids: bytes) -> None:
        total, top, at = len(ids) // 4, self.tiers[0], 0
        while total - at >= top:
            self._window(top, [(top, 0, doc, at, total, ids[4 * at : 4 * (at + top)])])
            at += top
        if at < total:
            self.serial += 1
            insort(self.pool, (total - at, self.serial, doc, at, total, ids[4 * at :]))
            self.held += total - at
        if self.held >= BLOCK_IDS:
            self._pack()

    def _window(self, size: int, pieces: list[tuple]) -> None:
        number = self.made.get(size)
        if number is not None:
            self.made[size] += 1
        offset = 0
        for length, _, doc, start, total, ids in pieces:
            for column, value in zip(self.rows, (doc, start, length, zlib.crc32(ids), total, self.base + self.next, offset, size, number), strict=True):
                column.append(value)
            offset += length
        self.next += 1

    def _fill(self, pool: list[tuple], pieces: list[tuple], gap: int) -> int:
        """Takes pieces from pool, whole where one fits, else the head of the shortest; what gap is left."""
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf")))
            if at:
                piece = pool.pop(at - 1)
                pieces.append(piece)
                gap -= piece[0]
            else:
                length, serial, doc, start, total, ids = pool.pop(0)
                pieces.append((gap, serial, doc, start, total, ids[: 4 * gap]))
                insort(pool, (length - gap, serial, doc, start + gap, total, ids[4 * gap :]))
                gap = 0
        return gap

    def _pack(self, last: bool = False) -> None:
        pool = self.pool
        for size, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while pool and pool[-1][0] > below and sum_at_least(pool, size):
                first = pool.pop()
                if first[0] > size:  # left from a longer tier that could not be filled
                    length, serial, doc, start, total, ids = first
                    insort(pool, (length - size, serial, doc, start + size, total, ids[4 * size :]))
                    first = size, serial, doc, start, total, ids[: 4 * size]
                pieces = [first]
                self._fill(pool, pieces, size - first[0])
                self._window(size, pieces)
        if last:
            size = self.tiers[0]
            while pool:
                total = sum(p[0] for p in pool)
                while size > total:
                    size //= 2
                pieces: list[tuple] = []
                self._fill(pool, pieces, size)
                self._window(size, pieces)
        self.held = sum(p[0] for p in pool)

    def end(self) -> None:
        self._pack(last=True)

    def take(self) -> pa.RecordBatch | None:
        if not self.rows[0]:
            return None
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.rows], schema=_schema)
        self.rows = [[] for _ in _schema]
        return out


def sum_at_least(pool: list[tuple], size: int) -> bool:
    total = 0
    for piece in reversed(pool):
        total += piece[0]
        if total >= size:
            return True
    return False


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece: its document's doc_id, start, length, ids_crc32 and doc_tokens, its sequence_id and offset there; window is the sequence's length, step_id its step group (null for windows shorter than any tier)."""
    if any(t & (t - 1) for t in tiers) or sorted(tiers, reverse=True) != list(tiers):
        raise ValueError("tiers are powers of two, the longest first")
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, tokens = Packer(TaskContext.get().partitionId() << TASK, tiers), encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), tokens.encode(some.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
            if (out := packer.take()) is not None:
                yield out
        packer.end()
        if (out := packer.take()) is not None:
            yield out
        del packer, out
        settle()

    pieces = cut(docs.select("doc_id", "text").mapInArrow(packed, PIECES))
    task = F.shiftright("sequence_id", TASK).alias("task")
    made = pieces.where("number is not null").groupBy(task, "window").agg((F.max("number") + 1).alias("made"))
    # Some tens of bytes for each task and tier.
    before = F.coalesce(F.sum("made").over(Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = made.select("task", "window", before.alias("before"))
    told = pieces.withColumn("task", task).join(first, ["task", "window"], "left")
    tier = F.array_position(F.array(*map(F.lit, tiers)), F.col("window")) - 1
    group = F.shiftleft(tier, 48) + F.floor((F.col("before") + F.col("number")) * F.col("window") / STEP_IDS).cast("long")
    return told.select(*COLUMNS[:-1], group.alias("step_id"))
