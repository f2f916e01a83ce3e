"""Operator 11: fill-in-middle by a parallel automaton scan.

A text is cut into tokens, runs of ASCII letters or single other characters, and two of its token borders, drawn from a hash of
doc_id, part it into prefix, middle and suffix. What must be known of a text (how many tokens it has, whether it has a
sentinel's string, where its u-th token begins) is what a finite automaton over its bytes tells.

A scan of a piece of text does not know in which state the automaton comes to it, so it gives a function from the state before
it to the state after it, and the tokens that begin in it for each kind of state before it. These functions have an
associative composition; there are few of them, so they are numbered and composed by a table (Automaton.then). A Tree composes
neighbours over and over; walking down it from the root finds the state at a place, or the place of the k-th token.
Texts of a batch stand in one tree, a reset byte before each, a function to the start state.

Texts of over CHUNK bytes are dealt out by chunk: each chunk gives its function and counts, composition over a text's chunks
resolves entry states and the text's number of tokens, and the two chunks with its cuts look for them. What meets for one text
is some forty bytes for each mebibyte. Only the text that is given back is one row, as it was in the input.

Nulls: a null text is an empty one, form plain; a null doc_id is hashed as an empty string. Rows with null or repeated doc_id are
transformed like others. Text that is not valid is not met: columns are strings. An empty table gives no rows. transform()
keeps all other columns, whatever their names."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, parts

SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk; longer texts are scanned by several tasks.
CHUNK = 1 << 20
#: Bytes of texts in one tree; with a reset for each text still below a power of two, to which trees are filled up.
TREE = (1 << 20) - (1 << 13)
RESET = 255  # no byte of UTF-8
PLAIN_FROM, SPM_BELOW = 90, 20


class Automaton:
    """States are (what of a sentinel has been read, whether the last byte is a letter), and two more once a sentinel has been read.

    exits[f, s] is the state that function f leads to from state s; function 0 is the identity. then[f, g] is f and after it g.
    opens[f, k] tells whether f ends in a letter, k whether there was one before it; found[s] whether s is after a sentinel."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        words = [s.encode() for s in sentinels]
        if not all(words):
            raise ValueError("sentinels are not empty")
        letter = np.zeros(256, bool)
        letter[65:91] = letter[97:123] = True

        def step(state: tuple, byte: int) -> tuple:
            if byte == RESET:
                return b"", False
            read = state[0]
            if read is not None:
                read += bytes([byte])
                if any(read.endswith(w) for w in words):
                    read = None
                else:
                    while not any(w.startswith(read) for w in words):
                        read = read[1:]
            return read, bool(letter[byte])

        states, steps = [(b"", False)], []
        for state in states:
            steps.append([step(state, b) for b in range(256)])
            states += [x for x in dict.fromkeys(steps[-1]) if x not in states]
        number = {x: i for i, x in enumerate(states)}
        moves = np.array([[number[x] for x in row] for row in steps]).T  # by byte and state
        known = {tuple(range(len(states))): 0}
        self.of_byte = np.array([known.setdefault(tuple(row), len(known)) for row in moves.tolist()], np.uint16)
        own = list(known)
        for f in own:  # the closure under one more byte is that under composition
            for row in np.unique(moves, axis=0).tolist():
                both = tuple(row[s] for s in f)
                if both not in known:
                    known[both] = len(known)
                    own.append(both)
        self.exits = np.array(own)
        self.then = np.array([[known[tuple(row)] for row in self.exits[:, f].tolist()] for f in self.exits], np.uint16)
        self.lettered = np.array([x[1] for x in states])
        self.found = np.array([x[0] is None for x in states])
        some = [int(np.flatnonzero(self.lettered == k)[0]) for k in (False, True)]
        self.opens = self.lettered[self.exits[:, some]]
        lead = np.ones(256, bool)
        lead[128:192] = lead[RESET] = False
        self.chars = lead.astype(np.int32)
        self.begins = np.stack([lead, lead & ~letter]).astype(np.int32)  # tokens that begin with a byte, without and with a letter before it


@functools.lru_cache(8)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


class Tree:
    """The composition of neighbours, level by level, over bytes. levels[k] has the functions, counts of tokens by kind of state before, and characters of 2**k bytes each."""

    def __init__(self, dfa: Automaton, data: np.ndarray):
        self.dfa, self.n = dfa, len(data)
        wide = 1 << max(0, (len(data) - 1).bit_length())
        f, tokens, chars = np.zeros(wide, np.uint16), np.zeros((2, wide), np.int32), np.zeros(wide, np.int32)
        f[: self.n], tokens[:, : self.n], chars[: self.n] = dfa.of_byte[data], dfa.begins[:, data], dfa.chars[data]
        self.levels = [(f, tokens, chars)]
        while len(f) > 1:
            left, right = f[0::2], f[1::2]
            first, second = tokens[:, 0::2], tokens[:, 1::2]
            tokens = np.stack([first[k] + np.where(dfa.opens[left, k], second[1], second[0]) for k in (0, 1)])
            f, chars = dfa.then[left, right], chars[0::2] + chars[1::2]
            self.levels.append((f, tokens, chars))

    def _walk(self, state: np.ndarray, right) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, states, tokens, characters) where walks down from the root end; right(k, tokens in the left child) tells which walks go right."""
        at, tokens, chars = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            f, counts, own = self.levels[k]
            at *= 2
            here = counts[self.dfa.lettered[state].astype(int), at]
            go = right(k, tokens + here)
            state = np.where(go, self.dfa.exits[f[at], state], state)
            tokens += np.where(go, here, 0)
            chars += np.where(go, own[at], 0)
            at += go
        return at, state, tokens, chars

    def before(self, places: np.ndarray, entry: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, tokens, characters) before each place, with the automaton in the state entry before the first; a place may be the end."""
        whole = places >= self.n
        _, state, tokens, chars = self._walk(np.full(len(places), entry), lambda k, _: (np.minimum(places, self.n - 1) >> k) & 1 == 1)
        f, counts, own = self.levels[-1]
        state, tokens = np.where(whole, self.dfa.exits[f[0], entry], state), np.where(whole, counts[int(self.dfa.lettered[entry]), 0], tokens)
        return state, tokens, np.where(whole, own[0], chars)

    def begin(self, tokens: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Characters before the token of each number (from 0); the numbers are below the number of tokens."""
        return self._walk(entry, lambda k, left: left <= tokens)[3]


def scan(texts: pa.Array, first: np.ndarray, second: np.ndarray, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its tokens n, whether it has a sentinel, and the characters before the tokens of number first % (n + 1) and second % (n + 1), the smaller first."""
    dfa, out = automaton(sentinels), [np.zeros(len(texts), np.int64) for _ in range(4)]
    for lo, hi, data, offs in chunks(texts, TREE):
        begin = offs + np.arange(hi - lo + 1)  # with a reset before each text
        marked = np.full(begin[-1], RESET, np.uint8)
        inside = np.ones(len(marked), bool)
        inside[begin[:-1]] = False
        marked[inside] = data
        tree = Tree(dfa, marked)
        state, tokens, chars = tree.before(np.append(begin[1:], begin[0]))
        base, skipped = np.roll(tokens, 1)[:-1], np.roll(chars, 1)[:-1]
        n = tokens[:-1] - base
        cuts = np.sort(np.stack([first[lo:hi] % (n + 1), second[lo:hi] % (n + 1)]), axis=0)
        found = [np.where(u < n, tree.begin(np.minimum(base + u, tokens[-2] - 1), np.zeros(hi - lo, np.int64)) if tokens[-2] else 0, chars[:-1]) - skipped for u in cuts]
        for column, own in zip(out, (n, dfa.found[state[:-1]], *found), strict=True):
            column[lo:hi] = own
    return out[0], out[1].astype(bool), out[2], out[3]


SCANNED = "n long, has_sentinel boolean, prefix_chars long, until_chars long"
_scanned = pa.struct([("n", pa.int64()), ("has_sentinel", pa.bool_()), ("prefix_chars", pa.int64()), ("until_chars", pa.int64())])
_row = [("key", pa.binary()), ("chunk", pa.int32())]
_chunk = pa.schema([*_row, ("raw", pa.binary()), ("first", pa.int64()), ("second", pa.int64())])
_place = pa.schema([*_row, ("number", pa.int32()), ("token", pa.int64()), ("entry", pa.int32()), ("base", pa.int64()), ("n", pa.int64()), ("has_sentinel", pa.bool_())])
_parts = pa.schema([*_row, ("function", pa.int32()), ("tokens", pa.list_(pa.int64())), ("chars", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])
_cut = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("has_sentinel", pa.bool_()), ("chars", pa.int64())])
CHUNKS = "key binary, chunk int, raw binary, first long, second long"
PARTS = "key binary, chunk int, function int, tokens array<long>, chars long, first long, second long"
PLACES = "key binary, chunk int, number int, token long, entry int, base long, n long, has_sentinel boolean"
CUTS = "key binary, n long, has_sentinel boolean, chars long"


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def giant(texts: DataFrame, sentinels: tuple[str, ...] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """(key, scanned) of texts (key, text, first, second), each scanned by chunk; keys are distinct."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, first, second = (batch.column(k)[i] for k in range(4))
                raw = text.as_buffer()
                for c, lo in enumerate(range(0, raw.size, chunk)):
                    yield _rows([(key.as_py(), c, raw[lo : lo + chunk].to_pybytes(), first.as_py(), second.as_py())], _chunk)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton(sentinels)
        for batch in batches:
            out = []
            for key, c, raw, first, second in zip(*(batch.column(k) for k in range(5)), strict=True):
                f, tokens, chars = Tree(dfa, np.frombuffer(raw.as_buffer(), np.uint8)).levels[-1]
                out.append((key.as_py(), c.as_py(), int(f[0]), tokens[:, 0].tolist(), int(chars[0]), first.as_py(), second.as_py()))
            yield _rows(out, _parts)

    def resolved(table: pa.Table) -> pa.Table:
        """One text's chunks: the state, tokens and characters before each, and the chunks of its two cuts."""
        dfa, rows = automaton(sentinels), sorted(table.to_pylist(), key=lambda r: r["chunk"])
        state, tokens, chars, before = 0, 0, 0, []
        for r in rows:
            before.append((state, tokens, chars))
            tokens += r["tokens"][int(dfa.lettered[state])]
            chars += r["chars"]
            state = int(dfa.exits[r["function"], state])
        ends, out = np.array([t for _, t, _ in before[1:]] + [tokens]), []
        for number, u in enumerate(sorted(rows[0][c] % (tokens + 1) for c in ("first", "second"))):
            at = int(np.searchsorted(ends, u, "right"))  # the first chunk with more tokens before its end
            entry, had, base = before[at] if u < tokens else (0, 0, chars)
            out.append((rows[0]["key"], rows[at]["chunk"] if u < tokens else -1, number, u - had if u < tokens else -1, entry, base, tokens, bool(dfa.found[state])))
        return pa.Table.from_batches([_rows(out, _place)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfa = automaton(sentinels)
        for batch in batches:
            out = []
            for key, raw, token, entry, base, n, has in zip(*(batch.column(k) for k in range(7)), strict=True):
                chars = base.as_py()
                if raw.is_valid:
                    chars += int(Tree(dfa, np.frombuffer(raw.as_buffer(), np.uint8)).begin(np.array([token.as_py()]), np.array([entry.as_py()]))[0])
                out.append((key.as_py(), n.as_py(), has.as_py(), chars))
            yield _rows(out, _cut)

    spark = texts.sparkSession
    pieces = texts.select("key", "text", "first", "second").mapInArrow(cut_up, CHUNKS).repartition(parts(spark), "key", "chunk")
    places = pieces.mapInArrow(functions, PARTS).groupBy("key").applyInArrow(resolved, PLACES)
    met = places.join(pieces.select("key", "chunk", "raw"), ["key", "chunk"], "left").select("key", "raw", "token", "entry", "base", "n", "has_sentinel").mapInArrow(found, CUTS)
    return met.groupBy("key").agg(F.struct(F.max("n").alias("n"), F.max("has_sentinel").alias("has_sentinel"), F.min("chars").alias("prefix_chars"), F.max("chars").alias("until_chars")).alias("scanned"))


def _draw(doc_id: Column, seed: str, k: int) -> Column:
    """The k-th 8 hex digits of the sha256 of seed:doc_id, from 1, as a number."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(hashed, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text, others) as a struct doc, with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the transformed text."""

    @F.arrow_udf(SCANNED)
    def scanned(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = scan(texts, first.to_numpy(), second.to_numpy(), sentinels)
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(found, _scanned, strict=True)], fields=list(_scanned))

    # Columns are kept in one struct, so theirs and ours cannot clash.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *(_draw(F.col("doc_id"), seed, k).alias(name) for k, name in enumerate(("first", "second", "third", "fourth"), 1)))
    long = F.octet_length("text") > chunk
    some = own.where(~long).withColumn("scanned", scanned("text", "first", "second"))
    # Rows of equal doc_id and text are one text: a key that does not depend on where a row is read survives a lost task.
    many = own.where(long).withColumn("key", F.unhex(F.sha2(F.concat(F.col("first").cast("string"), F.lit(":"), F.col("second").cast("string"), F.lit(":"), "text").cast("binary"), 256)))
    both = some.unionByName(many.join(giant(many.dropDuplicates(["key"]), sentinels, chunk), "key").drop("key"))
    plain = (F.col("text") == "") | F.col("scanned.has_sentinel") | (F.col("third") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("fourth") % 100 < spm_below, "spm").otherwise("psm")
    a, b = F.col("scanned.prefix_chars").cast("int"), F.col("scanned.until_chars").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    p, s, m = map(F.lit, sentinels)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return both.withColumn("form", form).select("doc", F.col("scanned.n").alias("n"), "form", cut(a).alias("prefix_chars"), cut(b - a).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from what transform() gave. No part of a text has a sentinel, so the first of each is the one put there."""
    p, s, m = sentinels

    def between(after: str, until: str) -> Column:
        rest = F.substring(output, F.lit(len(after) + 1), F.length(output))
        return F.substring_index(rest, until, 1)

    def after(mark: str, until: str | None = None) -> Column:
        at = F.locate(mark, output)
        rest = F.substring(output, at + len(mark), F.length(output))
        return F.substring_index(rest, until, 1) if until else rest

    psm = F.concat(between(p, s), after(m), after(s, m))
    spm = F.concat(after(p, m), after(m), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: str = "1", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each document."""
    made = transform(docs, seed, chunk=chunk)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
