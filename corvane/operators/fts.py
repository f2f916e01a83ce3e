"""Full-text queries: a parser of the query language, an index of postings and BM25, as one aggregation."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import in_directory
from ..functions.text import stem, stemmed, tokens, tokens_of
from ..session import cut
from .segments import Segments

COLUMNS = ("repo", "name", "title", "tags", "summary", "content")
# Fixed values of BM25 and of NEAR.
K1, B, LEAST_IDF, NEAR = 1.2, 0.75, 1e-6, 10


class QueryError(ValueError):
    pass


@dataclass
class Phrase:
    terms: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None
    number: int = -1


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int
    number: int = -1


@dataclass
class Node:
    op: str
    parts: list = field(default_factory=list)


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x80-\U0010ffff]+)|([(){}:+*^,-]))', re.ASCII)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"syntax error near {query[at:at + 9]!r}")
        out.append(("string", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else ("mark", m[3]))
        at = m.end()
    return out


class Parser:
    """Tightest first: juxtaposition, NOT, AND, OR; parentheses override. Operators are upper case."""

    def __init__(self, query: str, columns: tuple[str, ...] = COLUMNS):
        self.items, self.at, self.columns = _lex(query), 0, columns

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def parse(self) -> Node | Phrase | Near:
        out = self._or()
        if self.peek()[0] != "end":
            raise QueryError("syntax error")
        return out

    def _chain(self, op: str, below) -> Node | Phrase | Near:
        parts = [below()]
        while self.take(("word", op)):
            parts.append(below())
        if op == "NOT":
            out = parts[0]
            for p in parts[1:]:
                out = Node("NOT", [out, p])
            return out
        return Node(op, parts) if len(parts) > 1 else parts[0]

    def _or(self):
        return self._chain("OR", lambda: self._chain("AND", lambda: self._chain("NOT", self._implicit)))

    def _implicit(self):
        parts = [self._primary(None)]
        while self.peek()[0] in ("word", "string") and self.peek() not in (("word", "AND"), ("word", "OR"), ("word", "NOT")) or self.peek() in (("mark", "("), ("mark", "^"), ("mark", "{"), ("mark", "-")):
            parts.append(self._primary(None))
        return Node("AND", parts) if len(parts) > 1 else parts[0]

    def _columns(self) -> tuple[str, ...] | None:
        start, minus = self.at, self.take(("mark", "-"))
        names = []
        if self.take(("mark", "{")):
            while self.peek()[0] in ("word", "string"):
                names.append(self.peek()[1])
                self.at += 1
            if not self.take(("mark", "}")):
                raise QueryError("syntax error")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("mark", ":"):
            names.append(self.peek()[1])
            self.at += 1
        if not names or not self.take(("mark", ":")):
            if minus or names:
                raise QueryError("syntax error")
            self.at = start
            return None
        low = {c.lower(): c for c in self.columns}
        if any(n.lower() not in low for n in names):
            raise QueryError(f"no such column: {names}")
        chosen = tuple(low[n.lower()] for n in names)
        return tuple(c for c in self.columns if c not in chosen) if minus else chosen

    def _primary(self, inherited: tuple[str, ...] | None):
        own = self._columns()
        columns = own if inherited is None else inherited if own is None else tuple(c for c in own if c in inherited)
        if self.take(("mark", "(")):
            inside = self._or()
            if not self.take(("mark", ")")):
                raise QueryError("syntax error")
            for p in phrases(inside):
                if columns is not None:
                    p.columns = columns if p.columns is None else tuple(c for c in p.columns if c in columns)
            return inside
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            own, distance = [], NEAR
            while self.peek()[0] in ("word", "string"):
                own.append(self._phrase(columns))
            if self.take(("mark", ",")):
                if not self.peek()[1].isdigit():
                    raise QueryError("syntax error")
                distance = int(self.peek()[1])
                self.at += 1
            if not own or not self.take(("mark", ")")):
                raise QueryError("syntax error")
            return Near(own, distance)
        return self._phrase(columns)

    def _phrase(self, columns) -> Phrase:
        first = self.take(("mark", "^"))
        terms: list[str] = []
        while True:
            kind, text = self.peek()
            if kind not in ("word", "string") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise QueryError("syntax error")
            self.at += 1
            terms += tokens_of(text)
            if not self.take(("mark", "+")):
                break
        return Phrase(terms, self.take(("mark", "*")), first, columns)


def phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return [p for x in (node.phrases if isinstance(node, Near) else node.parts) for p in phrases(x)]


def literal(query: str) -> Node | Phrase | None:
    """Each token between white space as a quoted phrase, all of them needed."""
    parts = [Phrase(tokens_of(t)) for t in query.split()]
    return None if not parts else Node("AND", parts) if len(parts) > 1 else parts[0]


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> Node | Phrase | Near | None:
    """The query as it stands, or literally if it has an error; None matches nothing."""
    if not query.strip():
        return None
    try:
        return Parser(query, columns).parse()
    except QueryError:
        return literal(query)


@dataclass
class Index:
    """postings (term, spec_id, col, pos, n_tokens), lengths (spec_id, n_tokens). Written in order of term, Parquet's statistics prune them; a posting has its spec's length, so a query reads nothing but the postings of its terms and one row of totals."""

    postings: DataFrame
    lengths: DataFrame
    porter: bool = False
    totals: DataFrame | None = None
    columns: tuple[str, ...] = COLUMNS

    def whole(self) -> DataFrame:
        """One row: the number of specs and their mean length."""
        return self.totals if self.totals is not None else _totals(self.lengths)

    def none(self) -> DataFrame:
        return self.lengths.where(F.lit(False)).select("spec_id", F.lit(0.0).alias("rank"))

    def places(self, wanted: set[tuple[str, bool]]) -> DataFrame:
        return _places(self, wanted)


def _totals(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("mean_tokens"))


def index(specs: DataFrame, columns: tuple[str, ...] = COLUMNS, porter: bool = False) -> Index:
    flat = {c: F.concat_ws(", ", c) if dict(specs.dtypes)[c].startswith("array") else F.col(c) for c in columns}
    arrays = specs.select("spec_id", *(tokens(v).alias(c) for c, v in flat.items()))
    n = sum((F.size(c) for c in columns), F.lit(0)).cast("long").alias("n_tokens")
    # All columns' tokens as one array, so a text is tokenised once, whatever the number of columns.
    placed = F.concat(*(_placed(c) for c in columns))
    spread = arrays.select("spec_id", n, F.explode(placed).alias("p")).select("p.term", "spec_id", "p.col", "p.pos", "n_tokens")
    return Index(stemmed(spread) if porter else spread, arrays.select("spec_id", n), porter, None, columns)


def _placed(column: str) -> Column:
    return F.transform(F.col(column), lambda t, i: F.struct(t.alias("term"), F.lit(column).alias("col"), i.alias("pos")))


def save(idx: Index, path: str) -> None:
    """The index as Parquet, postings in order of term: a query's terms then prune all but a few row groups."""
    idx.postings.repartitionByRange("term", "spec_id").sortWithinPartitions("term", "spec_id", "col", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    idx.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    _totals(idx.lengths.sparkSession.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/totals")


def load(spark: SparkSession, path: str, porter: bool = False, columns: tuple[str, ...] = COLUMNS) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("postings"), read("lengths"), porter, read("totals"), columns)


def updated(idx: Index, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> Index:
    """The index after specs were changed or added (rows of specs) and others deleted (spec_id): what these had goes, and what the changed ones have now comes. Equal to an index of all specs made anew; written with save() to another path."""
    new = None if changed is None else index(changed, idx.columns, idx.porter)
    gone = [x.select("spec_id") for x in (changed, deleted) if x is not None]
    if not gone:
        return idx
    old = functools.reduce(DataFrame.union, gone).distinct()
    left = lambda df: df.join(old, "spec_id", "left_anti").select(*df.columns)
    postings, lengths = left(idx.postings), left(idx.lengths)
    if new is not None:
        postings, lengths = postings.unionByName(new.postings), lengths.unionByName(new.lengths)
    return Index(postings, lengths, idx.porter, None, idx.columns)


def _wanted(phrase: Phrase, k: int, porter: bool) -> tuple[str, bool]:
    """The k-th term of a phrase as the index has it, and whether it is a prefix."""
    prefix = phrase.prefix and k == len(phrase.terms) - 1
    return (stem(phrase.terms[k]) if porter and not prefix else phrase.terms[k]), prefix


def _is(term: Column, wanted: tuple[str, bool]) -> Column:
    return term.startswith(wanted[0]) if wanted[1] else term == wanted[0]


#: A place is the column's number in the upper bits and the position in the lower, so neighbours are of one column.
COLUMN = 1 << 32


def _places(idx: Index, wanted: set[tuple[str, bool]]) -> DataFrame:
    """(spec_id, n_tokens, places array<struct<term, at>>): where the wanted terms stand, by one scan of their postings."""
    exact, prefixes = sorted(t for t, p in wanted if not p), sorted(t for t, p in wanted if p)
    held = F.col("term").isin(exact) if exact else F.lit(False)
    for t in prefixes:
        held = held | F.col("term").startswith(t)
    number = F.array_position(F.array(*map(F.lit, idx.columns)), F.col("col")) - 1
    at = (number * COLUMN + F.col("pos")).alias("at")
    return idx.postings.where(held).groupBy("spec_id").agg(F.max("n_tokens").alias("n_tokens"), F.collect_list(F.struct("term", at)).alias("places"))


def _standing(wanted: tuple[str, bool], back: int) -> Column:
    """The places of a term, so far back."""
    return F.transform(F.filter("places", lambda x: _is(x["term"], wanted)), lambda x: x["at"] - back)


def _instances(idx: Index | Plan, phrase: Phrase) -> Column:
    """The places where the phrase begins."""
    none = F.expr("cast(array() as array<bigint>)")
    if not phrase.terms or phrase.columns == ():
        return none
    out = None
    for k in range(len(phrase.terms)):
        own = _standing(_wanted(phrase, k, idx.porter), k)
        out = own if out is None else F.array_intersect(out, own)
    if phrase.first:
        out = F.filter(out, lambda x: x % COLUMN == 0)
    if phrase.columns is not None:
        numbers = [idx.columns.index(c) for c in phrase.columns if c in idx.columns]
        out = F.filter(out, lambda x: F.floor(x / COLUMN).isin(numbers)) if numbers else none
    return out


def sweep(places: list[list[int]], lengths: list[int], distance: int) -> list[list[int]]:
    """Of ascending places of each phrase, those of the groups that a sweep from left to right meets: after a group, the phrase whose next place is the least moves on."""
    at, out = [0] * len(places), [[] for _ in places]
    while all(i < len(own) for i, own in zip(at, places, strict=True)):
        last = max(own[i] for i, own in zip(at, places, strict=True))
        behind = [k for k, own in enumerate(places) if own[at[k]] < last - lengths[k] - distance]
        if behind:
            for k in behind:
                at[k] += 1
            continue
        for k, own in enumerate(places):
            if out[k][-1:] != [own[at[k]]]:
                out[k].append(own[at[k]])
        nexts = [own[i + 1] if i + 1 < len(own) else float("inf") for i, own in zip(at, places, strict=True)]
        at[nexts.index(min(nexts))] += 1
    return out


def _swept(near: Near) -> Column:
    """Of each phrase of a NEAR group, the number of instances that stand in groups of all with at most distance tokens between; documents by Arrow batches."""
    lengths = [len(p.terms) for p in near.phrases]

    @F.pandas_udf("array<bigint>")
    def counted(*columns: pd.Series) -> pd.Series:
        return pd.Series([[len(x) for x in sweep([list(x) for x in row], lengths, near.distance)] for row in zip(*columns, strict=True)])

    return counted(*(F.sort_array(f"in{p.number}") for p in near.phrases))


def _nears(node) -> list[Near]:
    return [node] if isinstance(node, Near) else [] if isinstance(node, Phrase) else [n for x in node.parts for n in _nears(x)]


@dataclass
class Plan:
    """A parsed query: its phrases, numbered, the terms that they need, and what its rows are and score."""

    tree: Node | Phrase | Near
    porter: bool
    columns: tuple[str, ...]

    def __post_init__(self):
        self.phrases, self.nears = phrases(self.tree), _nears(self.tree)
        for k, p in enumerate(self.phrases):
            p.number = k
        self.wanted = {_wanted(p, k, self.porter) for p in self.phrases for k in range(len(p.terms))}

    def terms(self, p: Phrase) -> list[tuple[str, bool]]:
        return [_wanted(p, k, self.porter) for k in range(len(p.terms))]

    def truth(self, has, node=None) -> Column:
        """Whether a row matches, has(phrase) telling whether it has a phrase."""
        node = node or self.tree
        if isinstance(node, Phrase):
            return has(node)
        if isinstance(node, Near):
            return functools.reduce(lambda a, p: a & has(p), node.phrases[1:], has(node.phrases[0]))
        parts = [self.truth(has, x) for x in node.parts]
        out = parts[0]
        for x in parts[1:]:
            out = out & ~x if node.op == "NOT" else out & x if node.op == "AND" else out | x
        return out

    def scored(self, node=None) -> list[Phrase]:
        node = node or self.tree
        if isinstance(node, Node) and node.op == "NOT":
            return self.scored(node.parts[0])
        return phrases(node) if not isinstance(node, Node) else [p for x in node.parts for p in self.scored(x)]

    def counts(self, places: DataFrame) -> DataFrame:
        """spec_id, n_tokens, and of each phrase its frequency tf (in a NEAR group, of its instances there) and any, how often it stands in the spec at all."""
        own = places.select("spec_id", "n_tokens", *(_instances(self, p).alias(f"in{p.number}") for p in self.phrases))
        for k, near in enumerate(self.nears):
            own = own.withColumn(f"near{k}", _swept(near))
        frequency = {p.number: F.size(f"in{p.number}") for p in self.phrases}  # how many specs have the phrase at all tells how rare it is
        times = dict(frequency)
        for k, near in enumerate(self.nears):
            times |= {p.number: F.col(f"near{k}")[i] for i, p in enumerate(near.phrases)}
        return own.select("spec_id", "n_tokens", *(times[p.number].alias(f"tf{p.number}") for p in self.phrases), *(frequency[p.number].alias(f"any{p.number}") for p in self.phrases))

    def matched(self, counts: DataFrame) -> DataFrame:
        return counts.where(self.truth(lambda p: F.col(f"tf{p.number}") > 0))


def _impact(tf: Column, n_tokens: Column, mean_tokens: Column) -> Column:
    """What a phrase's frequency in a spec adds to its score, for each unit of the phrase's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / mean_tokens))


def search(idx: Index | Segments, query: str | Node | Phrase | Near, columns: tuple[str, ...] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """(spec_id, rank) of all specs that match a query, or one that is parsed already; less is better. Frequencies are those of the whole index, whatever the scope (spec_id) is."""
    tree = parse(query, columns or idx.columns) if isinstance(query, str) else query
    if tree is None:
        return idx.none()
    plan = Plan(tree, idx.porter, idx.columns)
    counts = plan.counts(idx.places(plan.wanted))
    frequencies = counts.agg(*(F.count_if(F.col(f"any{p.number}") > 0).alias(f"df{p.number}") for p in plan.phrases))
    # Two rows of sums: their size doesn't grow with the data.
    rows = plan.matched(counts).join(F.broadcast(frequencies.crossJoin(idx.whole())))
    score = F.lit(0.0)
    for p in plan.scored():
        n = F.col(f"df{p.number}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        score += F.when(idf <= 0, LEAST_IDF).otherwise(idf) * _impact(F.col(f"tf{p.number}").cast("double"), F.col("n_tokens"), F.col("mean_tokens"))
    out = rows.select("spec_id", (-score).alias("rank"))
    return out if scope is None else out.join(scope, "spec_id", "left_semi")


#: Blocks that are read without a look at their bounds, and the first that are read where there are more.
ALL_AT_ONCE, PROBED = 512, 16
#: Blocks up to which a chosen list of them is broadcast (12 bytes each).
FEW_BLOCKS = 1 << 18


def top(idx: Index | Segments, query: str | Node | Phrase | Near, limit: int = 200, columns: tuple[str, ...] | None = None, scope: DataFrame | None = None, at_once: int = ALL_AT_ONCE, probed: int = PROBED, told: dict | None = None) -> DataFrame:
    """The limit best rows of search(), in order. Of an index of segments, places are read only in blocks that can enter them.

    Each block's upper bound comes from the most places and the least length of its specs by term. The blocks of highest bounds are
    read first, more and more, until there are limit hits; then those whose bounds reach the last of these hits, and no others.
    told gets how many blocks can match and how many were read last."""
    tree = parse(query, columns or idx.columns) if isinstance(query, str) else query
    if tree is None:
        return idx.none()
    if not isinstance(idx, Segments):
        return search(idx, tree, columns, scope).orderBy("rank", "spec_id").limit(limit)
    plan = Plan(tree, idx.porter, idx.columns)
    wanted = sorted(plan.wanted)
    # Cut, as several choices are made from it; a row for each block that has any of the terms.
    bounds = cut(idx.bounds(wanted)) if wanted else None
    if bounds is None:
        return idx.none()
    inside = lambda p: functools.reduce(lambda a, w: a & F.col(f"tf{wanted.index(w)}").isNotNull(), plan.terms(p), F.lit(bool(p.terms) and p.columns != ()))
    n_docs, size = idx.totals()
    idf = {p.number: _idf(n, n_docs) for p, n in _rarity(idx, plan, bounds, inside).values()}
    mean = F.lit(size / n_docs if n_docs else 1.0)

    def bound(p: Phrase) -> Column:
        own = [wanted.index(w) for w in plan.terms(p)]
        if not own:
            return F.lit(0.0)
        tf, length = (f(*(F.col(f"{name}{k}") for k in own)) if len(own) > 1 else F.col(f"{name}{own[0]}") for f, name in ((F.least, "tf"), (F.greatest, "len")))
        return F.when(inside(p), idf[p.number] * _impact(tf.cast("double"), length, mean)).otherwise(0.0)

    def possible(node) -> Column:
        if isinstance(node, Phrase):
            return inside(node)
        if isinstance(node, Near):
            return functools.reduce(lambda a, p: a & inside(p), node.phrases, F.lit(True))
        parts = [possible(x) for x in node.parts]
        return parts[0] if node.op == "NOT" else functools.reduce(lambda a, b: a & b if node.op == "AND" else a | b, parts)

    most = sum((bound(p) for p in plan.scored()), F.lit(0.0)) * (1 + 1e-9)  # sums of doubles in another order may differ in their last places
    blocks = bounds.where(possible(tree)).select("segment", "block", most.alias("most"))
    n = blocks.count()

    def hits(chosen: DataFrame | None, few: bool = True) -> DataFrame:
        rows = plan.matched(plan.counts(idx.places(plan.wanted, None if chosen is None else chosen.select("segment", "block"), few)))
        score = sum((idf[p.number] * _impact(F.col(f"tf{p.number}").cast("double"), F.col("n_tokens"), mean) for p in plan.scored()), F.lit(0.0))
        out = rows.select("spec_id", (-score).alias("rank"))
        return out if scope is None else out.join(scope, "spec_id", "left_semi")

    chosen, few, read = blocks, n <= FEW_BLOCKS, n
    if n > at_once:
        some = probed
        while some < n:
            best = hits(blocks.orderBy(F.desc("most"), "segment", "block").limit(some)).orderBy("rank").limit(limit).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
            if best["n"] >= limit:
                chosen = blocks.where(F.col("most") >= -best["rank"])
                read = chosen.count()
                few = read <= FEW_BLOCKS
                if read <= 4 * some:  # else a look at some more blocks spares many
                    break
            some *= 4
    if told is not None:
        told |= {"blocks": n, "read": read}
    return hits(chosen, few).orderBy("rank", "spec_id").limit(limit)


def _idf(n: int, n_docs: int) -> float:
    value = math.log((n_docs - n + 0.5) / (n + 0.5))
    return value if value > 0 else LEAST_IDF


def _rarity(idx: Segments, plan: Plan, bounds: DataFrame, inside) -> dict[int, tuple[Phrase, int]]:
    """Of each phrase, how many specs have it: of a single term this is known from the postings' heads; of others it is counted in the blocks that have all their terms."""
    plain = {p.number: plan.terms(p)[0][0] for p in plan.phrases if len(p.terms) == 1 and not p.prefix and not p.first and p.columns is None}
    known = idx.frequencies(sorted(set(plain.values())))
    out = {k: known[t] for k, t in plain.items()}
    others = [p for p in plan.phrases if p.number not in plain]
    if others:
        blocks = bounds.where(functools.reduce(lambda a, p: a | inside(p), others, F.lit(False))).select("segment", "block")
        needed = {w for p in others for w in plan.terms(p)}
        if needed:
            own = idx.places(needed, blocks, blocks.count() <= FEW_BLOCKS).select(*(_instances(plan, p).alias(f"in{p.number}") for p in others))
            row = own.agg(*(F.count_if(F.size(f"in{p.number}") > 0).alias(f"df{p.number}") for p in others)).first()
            out |= {p.number: row[f"df{p.number}"] for p in others}
        else:
            out |= {p.number: 0 for p in others}
    return {p.number: (p, out[p.number]) for p in plan.phrases}


#: The fields of a hit.
HIT = ("spec_id", "repo", "project", "name", "title", "tags", "path", "ext")


def search_specs(idx: Index | Segments, specs: DataFrame, query: str, repos: list[str] | None = None, directory: str | None = None, limit: int | None = 200) -> DataFrame:
    """The best hits with the fields of their specs and their rank, of some repositories (an empty list: none) and of a directory if one is given."""
    wanted = specs if repos is None else specs.where(F.col("repo").isin(repos) if repos else F.lit(False))
    if directory:
        wanted = wanted.where(in_directory(F.col("path"), directory))
    fields = [c for c in HIT if c in specs.columns]
    scope = None if repos is None and not directory else wanted.select("spec_id")
    hits = search(idx, query) if limit is None else top(idx, query, limit, scope=scope)
    found = hits.join(wanted.select(*fields), "spec_id").select(*fields, "rank").orderBy("rank", "spec_id")
    return found if limit is None else found.limit(limit)
