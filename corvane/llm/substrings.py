"""Operator 8: exact substring deduplication by suffixes in deep-shallow order.

Each byte is removed that a 50-byte string covers which also starts in a document of a smaller doc_id. Sorting all
suffixes of all documents in one place does not scale, so suffixes are brought together by what they must share: the
smallest of the hashes of a 50-byte window's 24-byte strings depends on the window alone. Consecutive windows of one
smallest hash make a run, about one for 14 bytes.

1. Runs meet by their hash, packed by batch and bucket: 6 bytes and the doc_id each. A hash of one document concerns
   nobody. For any other, all that have it are told where its suffixes meet: by its smallest document, if few documents
   have it and their runs look alike (consecutive runs then travel as one segment); else by the hash itself; or, if very
   many unlike runs have it, each window by its own hash.
2. Batches send the distinct segments, runs and windows, with bytes, to where they meet. The suffixes at all windows are
   sorted there (suffixes.py), and each group of equal windows gets its smallest doc_id. Hashes only bring candidates
   together; what is equal is told by the order of the bytes.
3. The smallest doc_ids of the windows go back to the batches, which mark and cut.

Documents are dealt to batches by a hash of doc_id. Texts are shuffled once, for steps 2 and 3.

Nulls: a null text is an empty one; rows of a null doc_id are left as they are and remove nothing; rows of equal doc_id
don't remove from each other. Texts under 50 bytes are left as they are. An empty table gives an empty result. Other columns
are not read by digests() and are kept by cut_out()."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import BYTE_INV, FAN, MAIL, U, blocks_for, chunks, cut, delivered, gathered, mix, parts, posted, powers, prefix_hash, settle, spans, text_bytes

WINDOW, GRAM, RUN = 50, 24, 64
#: Bytes of text in a batch and in a bucket; distinct runs of a hash that make it hot; bytes that are sorted at once.
BATCH_BYTES, BUCKET_BYTES, HOT, SORT_BYTES = 8 << 20, 16 << 20, 4096, 1 << 20
#: Documents that may meet by the smallest of them; bytes of that document that are one meeting place; windows of a segment.
FEW, PLACE, SEGMENT = 64, 1 << 16, 1 << 16
LOW = U((1 << 32) - 1)
BY_HASH, BY_WINDOW = -(1 << 63), -(1 << 63) + 1  # in place of a doc_id


def sliding(x: np.ndarray, width: int, better: Callable) -> np.ndarray:
    reach, out = 1, x
    while reach * 2 <= width:
        out = better(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        out = better(out[: len(out) - rest], out[rest:])
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    prefix = prefix_hash(data)
    n = len(data) - GRAM + 1
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(BYTE_INV, n))


def window_runs(data: np.ndarray, offs: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows, hash) of each run of windows of the rows that use marks."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    least = sliding(gram_hashes(data), WINDOW - GRAM + 1, np.minimum)
    lengths = np.diff(offs)
    inside = np.zeros(len(data) + 1, np.int32)
    long = (lengths >= WINDOW) & use
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    row = np.searchsorted(offs, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    inner = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    new |= inner % RUN == 0
    begin = np.flatnonzero(new)
    return row[begin], at[begin], np.diff(np.append(begin, len(at))), mix(least[at[begin]])


def batch_of(doc: Column, batches: int) -> Column:
    """Rows of no doc_id are spread over all batches."""
    key = F.coalesce(doc.cast("string"), F.concat(F.lit("null"), F.monotonically_increasing_id().cast("string")))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(batches)).cast("int")


def _put(values: np.ndarray) -> bytes:
    """Numbers as differences from the smallest, in as many bytes as the largest needs, none if they are equal."""
    base = int(values.min())
    left = values.astype(np.uint64) - U(base & (2**64 - 1))
    width = (int(left.max()).bit_length() + 7) // 8
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + b"".join(((left >> U(8 * k)) & U(255)).astype(np.uint8).tobytes() for k in range(width))


def _get(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    base, width = int.from_bytes(raw[at : at + 8], "little", signed=True), raw[at + 8]
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out |= np.frombuffer(raw, np.uint8, n, at + 9 + k * n).astype(np.uint64) << U(8 * k)
    return (out + U(base & (2**64 - 1))).view(np.int64), at + 9 + width * n


def _send_runs(buckets: int, fan: int) -> Callable:
    """Step 1, of scans: for each bucket the runs' hashes, a few bits of their content, doc_ids and places in the documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            known = np.asarray(batch.column(0).is_valid())
            for lo, _, data, offs in chunks(batch.column(1), 8 << 20):
                found: list[tuple] = []
                # The hashes need several values of eight bytes for each byte of text, so these are of smaller pieces.
                for a, b, some, own in _pieces(data, offs):
                    row, start, count, hashed = window_runs(some, own, known[lo + a : lo + b])
                    if len(row):
                        content = spans(prefix_hash(some), start, start + count + WINDOW - 1)
                        found.append((hashed, content.astype(np.uint16), ids[lo + a + row], (start - own[row]) // PLACE))
                if not found:
                    continue
                hashed, content, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
                bucket, key = (hashed >> U(32)) % U(buckets), (hashed & LOW).astype(np.uint32)
                order = np.lexsort((place, doc, content, key, bucket))
                key, content, doc, place, bucket = key[order], content[order], doc[order], place[order], bucket[order]
                # A document's equal runs count once.
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
                key, content, doc, place, bucket = key[new], content[new], doc[new], place[new], bucket[new]
                begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                raws = [struct.pack("<I", y - x) + key[x:y].tobytes() + content[x:y].tobytes() + _put(doc[x:y]) + _put(place[x:y]) for x, y in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist(), strict=True)]
                yield posted(bucket[begin].tolist(), raws, buckets, fan)

    return send


def _pieces(data: np.ndarray, offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def _meet(batches: int, few: int, hot: int, fan: int) -> Callable:
    """Step 1, of a bucket: for each batch, the hashes that concern it, and where each meets: by a doc_id and a place there, or by a mark."""

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("to")[0].as_py()
        found: list[tuple] = []
        for raw in table.column("raw").to_pylist():
            at = 0
            while at < len(raw):
                (n,) = struct.unpack_from("<I", raw, at)
                key, content = np.frombuffer(raw, np.uint32, n, at + 4), np.frombuffer(raw, np.uint16, n, at + 4 + 4 * n)
                doc, at = _get(raw, at + 4 + 6 * n, n)
                place, at = _get(raw, at, n)
                found.append((key, content, doc, place))
        key, content, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.lexsort((place, doc, key))
        key, content, doc, place = key[order], content[order], doc[order], place[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        shared = doc[begin] != doc[np.append(begin[1:], len(key)) - 1]
        alike = np.logical_and.reduceat(content == np.repeat(content[begin], size), begin)
        own = np.where(alike & (size <= few), doc[begin], BY_HASH)
        for k in np.flatnonzero(shared & ~alike & (size > hot)).tolist():
            if len(np.unique(content[begin[k] : begin[k] + size[k]])) > hot:
                own[k] = BY_WINDOW
        where = np.where(own == doc[begin], place[begin], 0)
        told = np.repeat(shared, size)
        key, own, where, owner = key[told], np.repeat(own, size)[told], np.repeat(where, size)[told], doc[told]
        if not len(key):
            return pa.Table.from_batches([posted([], [], batches, fan)])
        unique, inverse = np.unique(owner, return_inverse=True)
        to = np.array([zlib.crc32(b"%d" % d) % batches for d in unique.tolist()], np.int32)[inverse]
        order = np.lexsort((key, to))
        key, own, where, to = key[order], own[order], where[order], to[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (to[1:] != to[:-1])
        key, own, where, to = key[new], own[new], where[new], to[new]
        begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        raws = []
        for x, y in zip(begin.tolist(), np.append(begin[1:], len(to)).tolist(), strict=True):
            packed = zlib.compress(own[x:y].tobytes() + where[x:y].astype(np.uint32).tobytes(), 1)
            raws.append(struct.pack("<III", bucket, y - x, len(packed)) + key[x:y].tobytes() + packed)
        return pa.Table.from_batches([posted(to[begin].tolist(), raws, batches, fan)])

    return meet


_answers = pa.schema([("to", pa.int32()), ("raw", pa.binary()), ("route", pa.int64()), ("content", pa.int64())])
ANSWERS = "to int, raw binary, route long, content long"


class Told:
    """What a batch has been told: where hashes meet, and the smallest doc_ids of the windows of what it sent there."""

    def __init__(self, answers: pa.Table, buckets: int):
        keys, marks, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.windows: dict[tuple[int, int], bytes] = {}
        sent = "route" in answers.column_names
        rows = zip(*(answers.column(c).to_pylist() for c in (("raw", "route", "content") if sent else ("raw",))), strict=True)
        for raw, *where in rows:
            if sent and where[0] is not None:
                self.windows[where[0], where[1]] = raw
                continue
            at = 0
            while at < len(raw):
                bucket, n, size = struct.unpack_from("<III", raw, at)
                keys.append(np.frombuffer(raw, np.uint32, n, at + 12).astype(np.uint64) | U(bucket << 32))
                plain = zlib.decompress(raw[at + 12 + 4 * n : at + 12 + 4 * n + size])
                marks.append(np.frombuffer(plain, np.int64, n))
                places.append(np.frombuffer(plain, np.uint32, n, 8 * n).astype(np.int64))
                at += 12 + 4 * n + size
        key, mark, place = np.concatenate(keys), np.concatenate(marks), np.concatenate(places)
        order = np.argsort(key)
        self.key, self.mark, self.place, self.buckets = key[order], mark[order], place[order], buckets

    def sent(self, data: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, windows, route, content) of the segments, runs and windows that meet others: the same whenever it is asked."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(self.key) or not len(row):
            return none
        key = (hashed >> U(32)) % U(self.buckets) << U(32) | hashed & LOW
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        some = np.flatnonzero(self.key[at] == key)
        if not len(some):
            return none
        at, key, row, start, count = at[some], key[some], row[some], start[some], count[some]
        mark, place = self.mark[at], self.place[at]
        route = np.where(mark == BY_HASH, mix(key), mix(mark.view(np.uint64) * U(0x9E3779B97F4A7C15) + place.astype(np.uint64))).view(np.int64)
        # Consecutive runs of one meeting place by document are one segment.
        new = np.ones(len(some), bool)
        new[1:] = (mark[1:] == BY_HASH) | (mark[1:] == BY_WINDOW) | (mark[1:] != mark[:-1]) | (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])
        begin = np.flatnonzero(new)
        within = start - start[np.repeat(begin, np.diff(np.append(begin, len(some))))]
        new[1:] |= ~new[1:] & (within[1:] // SEGMENT != within[:-1] // SEGMENT)
        begin = np.flatnonzero(new)
        windows = np.add.reduceat(count, begin)
        row, start, route, mark = row[begin], start[begin], route[begin], mark[begin]
        single = mark == BY_WINDOW
        if single.any():
            times = np.where(single, windows, 1)
            inner = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, start, route, single = np.repeat(row, times), np.repeat(start, times) + inner, np.repeat(route, times), np.repeat(single, times)
            windows = np.where(single, 1, np.repeat(windows, times))
        content = spans(prefix_hash(data), start, start + windows + WINDOW - 1).view(np.int64)
        return row, start, windows, np.where(single, content, route), content


_sent = pa.schema([("route", pa.int64()), ("content", pa.int64()), ("batch", pa.int32()), ("doc_id", pa.int64()), ("windows", pa.int32()), ("raw", pa.binary())])
SENT = "route long, content long, batch int, doc_id long, windows int, raw binary"


def _texts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    ids, known = table.column("doc_id").combine_chunks(), np.asarray(table.column("doc_id").is_valid())
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi, data, offs in chunks(table.column("text"), 1 << 20):
        yield lo, hi, data, offs, ids[lo:hi], known[lo:hi]


def _send_bytes(buckets: int) -> Callable:
    """Step 2, of a batch: what it sends to meet others, equal bytes once with their smallest doc_id."""

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        settle()  # what the batch before left
        told = Told(answers, buckets)
        batch = docs.column("_corvane_batch")[0].as_py() if docs.num_rows else 0
        found: dict[tuple[int, int], list] = {}
        for _, _, data, offs, ids, known in _texts(docs):
            row, start, windows, route, content = told.sent(data, *window_runs(data, offs, known))
            raw = data.tobytes()
            for r, c, d, w, s in zip(route.tolist(), content.tolist(), ids[row].tolist() if len(row) else [], windows.tolist(), start.tolist(), strict=True):
                have = found.get((r, c))
                if have is None:
                    found[r, c] = [d, w, raw[s : s + w + WINDOW - 1]]
                elif d < have[0]:
                    have[0] = d
        rows = [(r, c, batch, d, w, x) for (r, c), (d, w, x) in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _sent, strict=True)], schema=_sent)

    return send


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, of meeting places in order: the smallest doc_id of each window, as stretches of equal ones, for each batch that sent it."""
    strings: dict[tuple[int, bytes], list] = {}
    askers: list[tuple[int, int, int, tuple[int, bytes]]] = []
    held, last = 0, None

    def done() -> pa.RecordBatch:
        nonlocal held, strings, askers
        count = np.array([w for _, w in strings.values()])
        begin = np.concatenate(([0], np.cumsum([len(x) for _, x in strings])[:-1]))
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        routes = np.array([r for r, _ in strings])
        order, group = suffixes.sort(b"".join(x for _, x in strings), np.repeat(begin, count) + inner, WINDOW, np.repeat(routes, count))
        doc = np.repeat(np.array([d for d, _ in strings.values()]), count)[order]
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(doc, heads)[group]
        new = inner == 0
        new[1:] |= least[1:] != least[:-1]
        at = np.flatnonzero(new)
        ends, docs, lengths = np.searchsorted(at, np.cumsum(count)), least[at], np.diff(np.append(at, len(least))).astype(np.uint32)
        told = {key: docs[a:b].tobytes() + lengths[a:b].tobytes() for key, a, b in zip(strings, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}
        out = pa.RecordBatch.from_arrays([pa.array([a[2] for a in askers], pa.int32()), pa.array([told[a[3]] for a in askers], pa.binary()), pa.array([a[0] for a in askers], pa.int64()), pa.array([a[1] for a in askers], pa.int64())], schema=_answers)
        held, strings, askers = 0, {}, []
        return out

    for batch in batches:
        for route, content, to, doc, windows, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if route != last and held >= SORT_BYTES:
                yield done()
            last = route
            have = strings.get((route, raw))
            if have is None:
                strings[route, raw] = [doc, windows]
                held += len(raw)
            elif doc < have[0]:
                have[0] = doc
            askers.append((route, content, to, (route, raw)))
    if strings:
        yield done()
    settle()


def marked(table: pa.Table, answers: pa.Table, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Step 3: (first row, bytes, offsets, which bytes go) of the texts, piece by piece."""
    settle()  # what the batch before left
    told = Told(answers, buckets)
    for lo, _, data, offs, ids, known in _texts(table):
        change = np.zeros(len(data) + WINDOW, np.int32)
        row, start, windows, route, content = told.sent(data, *window_runs(data, offs, known))
        if len(row):
            stretches = [told.windows[x] for x in zip(route.tolist(), content.tolist(), strict=True)]
            number = np.array([len(x) // 12 for x in stretches])
            least = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(stretches, number.tolist(), strict=True)])
            length = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(stretches, number.tolist(), strict=True)]).astype(np.int64)
            before = np.cumsum(length) - length
            begin = np.cumsum(number) - number
            at = np.repeat(start, number) + before - np.repeat(before[begin], number)
            gone = np.repeat(ids[row], number) > least
            np.add.at(change, at[gone], 1)
            np.add.at(change, at[gone] + length[gone] + WINDOW - 1, -1)
        yield lo, data, offs, np.cumsum(change[: len(data)]) > 0


def _run(docs: DataFrame, finish: Callable, schema, batch_bytes: int, bucket_bytes: int, hot: int, few: int, fan: int) -> DataFrame:
    spark = docs.sparkSession
    size = text_bytes(docs)
    batches, buckets = blocks_for(size, batch_bytes), max(parts(spark), blocks_for(size, bucket_bytes))
    wanted = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    own = "_corvane_batch"  # docs may have a column named batch
    packed = delivered(wanted.select("doc_id", "text").mapInArrow(_send_runs(buckets, fan), MAIL), buckets, fan)
    met = packed.groupBy("to").applyInArrow(_meet(batches, few, hot, fan), MAIL)
    first = cut(gathered(delivered(met, batches, fan), batches, 1))
    dealt = wanted.withColumn(own, batch_of(F.col("doc_id"), batches))
    sent = dealt.groupBy(own).cogroup(first.groupBy("to")).applyInArrow(_send_bytes(buckets), SENT)
    ordered = sent.repartition(parts(spark), "route").sortWithinPartitions("route", "content")
    answers = first.select("*", F.lit(None).cast("long").alias("route"), F.lit(None).cast("long").alias("content")).union(ordered.mapInArrow(_sort_blocks, ANSWERS))
    return dealt.groupBy(own).cogroup(answers.groupBy("to")).applyInArrow(finish(buckets), schema)


def digests(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, few: int = FEW, fan: int = FAN) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(buckets: int) -> Callable:
        def rows(table: pa.Table, answers: pa.Table) -> pa.Table:
            ids, out = table.column("doc_id").to_pylist(), []
            for lo, data, offs, gone in marked(table, answers, buckets):
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                begins = offs[:-1][offs[1:] > offs[:-1]]
                first[begins] = gone[begins]
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    own = gone[a:b]
                    out.append((ids[lo + i], b - a, int(own.sum()), int(first[a:b].sum()), hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return rows

    return _run(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", batch_bytes, bucket_bytes, hot, few, fan)


def cut_out(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, few: int = FEW, fan: int = FAN) -> DataFrame:
    """docs with their texts cut, other columns as they are (n_chars, if there, is counted anew). Where a cut splits a character, its other bytes go too. A text of which nothing is left is empty."""
    names, kinds = docs.columns, docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema

    def finish(buckets: int) -> Callable:
        def rows(table: pa.Table, answers: pa.Table) -> pa.Table:
            texts: list[str | None] = table.column("text").to_pylist()
            for lo, data, offs, gone in marked(table, answers, buckets):
                for i in np.unique(np.searchsorted(offs, np.flatnonzero(gone), "right") - 1).tolist():
                    own = slice(int(offs[i]), int(offs[i + 1]))
                    texts[lo + i] = data[own][~gone[own]].tobytes().decode("utf-8", "ignore")
            out = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                at = table.schema.get_field_index("n_chars")
                out = out.set_column(at, "n_chars", pa.array([n if t is None else len(t) for t, n in zip(texts, table.column("n_chars").to_pylist(), strict=True)], pa.int64()).cast(table.schema.field(at).type))
            return out.select(names)

        return rows

    return _run(docs, finish, kinds, batch_bytes, bucket_bytes, hot, few, fan)
