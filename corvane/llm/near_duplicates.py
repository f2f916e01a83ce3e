"""Operator 4: n-gram Jaccard join by a MinHash LSH forest.

Texts of equal shingle sets are one class, whatever their number. A class's MinHash signature has DEPTH values for each of
TREES prefix tries. A trie is its sorted signatures: all tries are sorted at once, over all tasks, and gone through in order.
Each class is matched at the longest prefix that it shares with those before it, and linked to the first class of that
prefix; where neighbours share no longer one, the prefix is shortened, down to the length at which the chance that a pair
of the threshold's similarity meets in some trie reaches the target recall. So a class has one link at most in each trie,
whatever the size of its group. Connected components of these links are the candidate groups. Their texts are fetched once
and verified by exact Jaccard similarity of shingle sets within the group. A group too large for a task is split by the
number of shingles, in classes by powers of 1 / threshold, and these into blocks: only blocks of one class or of classes next
to each other can hold similar texts, and are verified in pairs. Counts of links and spanning trees leave the task, not pairs.

Nulls: a null text has no words; documents without words are linked to nothing, each its own class, as are rows of a null
doc_id (class_id null). Rows of equal doc_id and text count as copies. An empty table gives an empty result. Other columns
are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SIMILAR, U, components, cut, gathered, join_unique, mix, parts, settle, shingles

TREES, DEPTH, TARGET = 24, 6, 0.9999
#: Shingles of one verification block; a block of a group is at most this, apart from a single text.
BLOCK_SHINGLES = 1 << 20
#: Places of a text's shingles in other texts of its block that are counted at once.
AT_ONCE = 1 << 19
_rng = np.random.Generator(np.random.PCG64(7))
MULTIPLY = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1)
ADD = _rng.integers(0, 2**64 - 1, TREES * DEPTH, dtype=np.uint64)


def recall(depth: int, threshold: float = SIMILAR, trees: int = TREES) -> float:
    """The chance that two texts of the threshold's similarity have a prefix of that depth in common in some trie."""
    return 1 - (1 - threshold**depth) ** trees


def least_depth(threshold: float = SIMILAR, target: float = TARGET) -> int:
    """The longest prefix length that reaches the target recall; 1 if none does."""
    return next((d for d in range(DEPTH, 1, -1) if recall(d, threshold) >= target), 1)


def signature(own: np.ndarray) -> np.ndarray:
    """For each tree, its number and DEPTH values of two bytes: a label whose order is that of the trie."""
    out = np.full(TREES * DEPTH, 2**64 - 1, np.uint64)
    for lo in range(0, len(own), 1024):
        part = own[lo : lo + 1024, None] * MULTIPLY[None, :]
        part += ADD[None, :]
        np.minimum(out, part.min(axis=0), out=out)
    labels = np.empty((TREES, 1 + 2 * DEPTH), np.uint8)
    labels[:, 0] = np.arange(TREES)
    labels[:, 1:] = mix(out).astype(">u2").reshape(TREES, DEPTH).view(np.uint8)
    return labels


def node_of(own: np.ndarray) -> bytes:
    """The name of the class of texts of these shingles: 128 bits."""
    import hashlib

    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_shingles, labels): labels has those of all trees, one after the other. Rows without words or doc_id, which are linked to nothing, have names of their own and no labels."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("labels", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for i, own in shingles(batch.column(1), 1 << 20):
                alone = not len(own) or ids[i] is None
                out.append((ids[i], b"%d" % i, 0, None) if alone else (ids[i], node_of(own), len(own), signature(own).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        settle()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, node binary, n_shingles long, labels binary")


_walked = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("label", pa.binary())])
WALKED = "a binary, b binary, label binary"


def _walk(least: int) -> Callable:
    """Of sorted (label, node): links (a, b, null) of each node to the first of the longest prefix that it shares with the row before it, and the first and the last row as (node, null, label)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 + 2 * DEPTH
        before, heads = None, [b""] * (DEPTH + 1)  # the label before, and the first node of its prefix of each length
        last: tuple[bytes, bytes] | None = None
        for batch in batches:
            labels, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not labels:
                continue
            own = np.frombuffer(b"".join(labels), np.uint8).reshape(-1, size)
            above = np.vstack([before if before is not None else own[:1], own[:-1]])
            same = (own[:, 1::2] == above[:, 1::2]) & (own[:, 2::2] == above[:, 2::2]) & (own[:, :1] == above[:, :1])
            shared = np.cumprod(same, axis=1).sum(axis=1)
            if before is None:
                shared[0] = 0
            out = [] if before is not None else [(nodes[0], None, labels[0])]
            for node, n in zip(nodes, shared.tolist(), strict=True):
                if n >= least and heads[n] != node:
                    out.append((node, heads[n], None))
                heads[n + 1 :] = [node] * (DEPTH - n)
            before, last = own[-1:], (nodes[-1], labels[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 3, schema=_walked)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.binary()), pa.array([None], pa.binary()), pa.array([last[1]], pa.binary())], schema=_walked)

    return walk


def candidate_links(classes: DataFrame, least: int, n: int | None = None) -> DataFrame:
    """(a, b): links of the classes (node, labels), n in number if that is known, that share a prefix of that length or a longer one.

    Rows of one prefix may lie in several tasks. The first and last rows of all tasks, two for each, are gone through once more by one task, which links what a border parted."""
    size = 1 + 2 * DEPTH
    spread = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels").select(F.substring(F.col("labels"), F.col("tree") * size + 1, F.lit(size)).alias("label"), "node")
    ordered = spread.repartitionByRange(parts(classes.sparkSession), "label", "node").sortWithinPartitions("label", "node")
    walked = ordered.mapInArrow(_walk(least), WALKED)
    walked = cut(walked if n is None else gathered(walked, TREES * n))
    borders = walked.where("b is null").select("label", F.col("a").alias("node")).repartition(1).sortWithinPartitions("label", "node")
    return walked.where("b is not null").select("a", "b").union(borders.mapInArrow(_walk(least), WALKED).where("b is not null").select("a", "b"))


def verify(rows: list[tuple[bytes, int, int, np.ndarray]], first: int, second: int, threshold: float) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Counts of linked documents, by class, and a spanning forest of the links.

    rows: (node, block, copies, shingles) of the blocks first and second, or of one if they are equal. A link's two ends are in unlike blocks if these are unlike."""
    order = np.argsort([len(r[3]) for r in rows], kind="stable")
    rows = [rows[k] for k in order]
    sizes = np.array([len(r[3]) for r in rows])
    block = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows])
    every = np.concatenate([r[3] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    group = np.empty(len(every), np.int64)
    group[by] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(every))))
    end = np.append(begin[1:], len(every))
    counts, forest, root = np.zeros(len(rows), np.int64), [], list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    share, begins = Fraction(str(threshold)), np.cumsum(sizes) - sizes
    lengths_of = end - begin
    for i in range(len(rows)):
        own = group[begins[i] : begins[i] + sizes[i]]
        # What is as similar has that share of the shingles at least, so one of the rarest, whichever these are.
        rare = own[np.argsort(lengths_of[own], kind="stable")[: max(0, len(own) + int(-len(own) * share // 1) + 1)]]
        met = np.unique(np.concatenate([owner[:0], *(owner[begin[k] : end[k]] for k in rare)])) if int(lengths_of[rare].sum()) * 8 < len(rows) else None
        if met is not None and len(met) * (len(own) + 2000) < int(lengths_of[own].sum()) + len(rows):
            # Few texts are met: each is compared by itself.
            met = met[met != i]
            common = np.array([len(np.intersect1d(own, group[begins[j] : begins[j] + sizes[j]], assume_unique=True)) for j in met], np.int64)
        else:
            met, common = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            lengths = lengths_of[own]
            upto, lo = np.cumsum(lengths), 0
            while lo < len(own):
                before = int(upto[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, before + AT_ONCE, "right")))
                some, length, lo = own[lo:hi], lengths[lo:hi], hi
                where = np.repeat(begin[some] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
                common += np.bincount(owner[where], minlength=len(rows))
        # Jaccard similarity, in whole numbers: common / (sizes of both - common).
        with_it = (1000 * common >= int(round(1000 * threshold)) * (sizes[met] + sizes[i] - common)) & (met != i)
        if first != second:
            with_it &= block[met] != block[i]
        linked = met[with_it]
        counts[i] = int(copies[linked].sum())
        for j in linked:
            if j < i and (a := top(i)) != (b := top(int(j))):
                root[max(a, b)] = min(a, b)
                forest.append((rows[i][0], rows[j][0]))
    return {rows[i][0]: int(counts[i]) for i in np.flatnonzero(counts)}, forest


def _verified(members: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, other, root): links of a class found in one pair of blocks; or a link to another class; or, of a group verified as a whole, the smallest class that links lead to."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id")
    dealt = texts.select("component", F.explode("pairs").alias("p"), "node", "block", "copies", "text").select("component", "p.first", "p.second", "node", "block", "copies", "text")
    dealt = dealt.repartition(parts(docs.sparkSession), "component", "first", "second").sortWithinPartitions("component", "first", "second")
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("other", pa.binary()), ("root", pa.binary())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        out: list[tuple] = []

        def done() -> None:
            nonlocal rows
            if len(rows) > 1:
                counts, forest = verify(list(rows.values()), key[1], key[2], threshold)
                out.extend((n, c, None, None) for n, c in counts.items())
                if key[1] == WHOLE:
                    out.extend((n, None, None, r) for n, r in rooted(forest).items())
                else:
                    out.extend((a, None, b, None) for a, b in forest)
            rows = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for i, own in shingles(batch.column(6), 1 << 20):
                now = columns[0][i], columns[1][i], columns[2][i]
                if now != key:
                    done()
                    key = now
                node = columns[3][i]
                if node not in rows and node_of(own) == node:  # else another row of the same doc_id
                    rows[node] = node, columns[4][i], columns[5][i], own
            if out:
                yield told()
                out.clear()
        done()
        if out:
            yield told()
        settle()

    return dealt.mapInArrow(checked, "node binary, links long, other binary, root binary")


def rooted(forest: list[tuple[bytes, bytes]]) -> dict[bytes, bytes]:
    """The smallest node that links lead to, of each node of the trees."""
    near: dict[bytes, list[bytes]] = {}
    for a, b in forest:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out: dict[bytes, bytes] = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            node = todo.pop()
            if node not in out:
                out[node] = start
                todo += near[node]
    return out


#: In place of a block's number: the group is verified as a whole. Blocks are numbered from 0 within a class of sizes.
WHOLE, CLASS = -1, 1 << 32


def _dealt(grouped: DataFrame, threshold: float, block_shingles: int) -> DataFrame:
    """grouped (component, node, n_shingles, ...) with each class's block and the pairs of blocks in which it is verified."""
    number = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("long")
    sized = grouped.withColumn("size", number)
    weight = sized.groupBy("component", "size").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("n"))
    # As many entries as classes of sizes, some tens.
    entry = F.struct("size", F.ceil(F.col("total") / block_shingles).cast("long").alias("n"))
    told = weight.groupBy("component").agg(F.map_from_entries(F.collect_list(entry)).alias("blocks"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    met = join_unique(sized, told, "component", "n", grouped.count())
    whole = F.col("total") <= block_shingles
    blocks = lambda size: F.coalesce(F.try_element_at("blocks", size), F.lit(0).cast("long"))
    block = F.when(whole, F.lit(WHOLE).cast("long")).otherwise(F.col("size") * CLASS + F.pmod(F.xxhash64("node"), blocks(F.col("size"))))
    met = met.withColumn("block", block)
    pair = lambda other: F.struct(F.least("block", other).alias("first"), F.greatest("block", other).alias("second"))
    near = lambda size: F.when(blocks(size) > 0, F.transform(F.sequence(F.lit(0).cast("long"), blocks(size) - 1), lambda k: pair(size * CLASS + k))).otherwise(F.expr("cast(array() as array<struct<first: bigint, second: bigint>>)"))
    pairs = F.when(whole, F.array(pair(F.col("block")))).otherwise(F.concat(*(near(F.col("size") + k) for k in (-1, 0, 1))))
    return met.select(*grouped.columns, "block", pairs.alias("pairs"))


def join(docs: DataFrame, threshold: float = SIMILAR, target: float = TARGET, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """A row for each document: doc_id, class_id (the smallest doc_id that links lead to), n_links (documents of that similarity, copies among them)."""
    marked = cut(signed(docs))
    n_docs = marked.count()
    nodes = cut(gathered(marked.where("labels is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")), n_docs))
    n = nodes.count()
    groups = components(candidate_links(nodes, least_depth(threshold, target), n), most=TREES * n)
    grouped = cut(gathered(groups.select("node", "component").distinct().join(nodes.drop("labels"), "node"), n))
    members = _dealt(grouped, threshold, block_shingles).select("doc_id", "node", "component", "copies", "block", "pairs")
    found = cut(_verified(members, docs, threshold))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = found.where("root is not null").select("node", F.col("root").alias("component"))
    split = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    if not split.isEmpty():
        classes = classes.union(components(split, most=found.count()))
    led = nodes.drop("labels").join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = led.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    named = join_unique(led, least, "component", "n", n).select("node", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = cut(gathered(named, n))
    out = join_unique(marked.select("doc_id", "node"), named, "node", "copies", n_docs, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns, of the smallest doc_id of each class; rows of a null doc_id stay."""
    kept = cut(gathered(join(docs, threshold).where("doc_id = class_id").select("doc_id").distinct(), docs.select("doc_id").count()))
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
