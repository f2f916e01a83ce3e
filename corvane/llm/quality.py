"""Operator 1 [native]: quality rules as weak supervision.

Rules look at a document's counts and vote 1 (good), -1 (bad) or 0 (abstain). Expectation-maximisation over the counts of
vote patterns estimates, for each of the two hidden classes, how often a rule gives each vote; the posterior probability
of the good class replaces all-must-pass filtering. There are 3**rules patterns at most, whatever the number of
documents, so the histogram that the driver takes is bounded; its counts come from all documents.

Nulls: a null text is an empty one: no words, base_failed. Rows with a null or repeated doc_id are judged like others. An
empty table gives an empty result (the model is then its prior). Other columns are not read by score(); filter() keeps them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Letters with their marks, digits and the joiners within words, and capitals, of all scripts.
ALNUM, UPPER = r"[\p{L}\p{M}\p{N}\x{200C}\x{200D}]", r"\p{Lu}"
MIN_WORDS, REPEAT_PERCENT = 50, 50
GOOD = 0.5  # the posterior from which a document is kept
VOTES = (1, 0, -1)
#: Pseudo-counts, as a share of all documents: the prior that good documents get good votes rather than bad ones. Together a
#: hundredth of the documents, so that the votes themselves decide wherever a rule votes at all; chosen by hand, not fitted to
#: any labels. What they settle is which hidden class is called good, which expectation-maximisation cannot know.
PRIOR = {"good": {1: 0.008, 0: 0.002, -1: 0.0001}, "bad": {1: 0.002, 0: 0.002, -1: 0.006}}
#: Where expectation-maximisation starts, by hand as well: good documents hardly ever get a bad vote. The test of accuracies
#: starts here and finds those of made-up rules.
START = {"good": {1: 0.8, 0: 0.19, -1: 0.01}, "bad": {1: 0.45, 0: 0.25, -1: 0.3}}


def let(value: Column, body) -> Column:
    """body(value), value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words stand in three-word windows that the text has twice or more."""

    def covered(places: Column) -> Column:
        gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, x: a + x)

    def marked(ordered: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"])
        twice = F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False)))
        # A null beside the first or the last entry leaves the other comparison to decide.
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        three = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        all_of = F.when(F.size(hashes) >= 3, F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), three)).otherwise(F.expr("array(cast(null as bigint))"))
        ordered = lambda w: let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)
        return let(all_of, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(ordered(w)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at. The arrays of words and lines stay in the row; nothing is shuffled."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(UPPER)).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(ALNUM)).cast("long").alias("n_alnum"),
    )
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "n_upper",
        "n_alnum",
    )


def _ratio(over: str, under: str) -> Column:
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The votes, by rule; each depends on the document alone."""
    mean, symbols, repeats = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words")
    lines, distinct, upper = _ratio("n_dup_lines", "n_lines"), _ratio("n_distinct", "n_words"), _ratio("n_upper", "n_alnum")
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < MIN_WORDS),
        "word_length": _vote(mean.between(3, 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(symbols < 0.05, symbols > 0.25),
        "repeats": _vote(repeats < 0.2, repeats > 0.4),
        "lines": _vote(lines < 0.1, lines > 0.4),
        "variety": _vote(distinct > F.lit(0.35), distinct < 0.15),
        "capitals": _vote(upper < 0.2, upper > 0.5),
        "letters": _vote(_ratio("n_alnum", "word_chars") > 0.93, _ratio("n_alnum", "word_chars") < 0.88),
    }


class Model:
    """rates[class][rule][vote] and the share of the good class."""

    def __init__(self, names: list[str]):
        self.names, self.share = names, 0.8
        self.rates = {c: {n: dict(START[c]) for n in names} for c in START}

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.share) - math.log(1 - self.share)
        for n, v in zip(self.names, votes, strict=True):
            odds += math.log(self.rates["good"][n][v]) - math.log(self.rates["bad"][n][v])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

    def accuracies(self) -> dict[str, float]:
        """How often a rule's vote is right when it votes."""
        out = {}
        for n in self.names:
            right = self.share * self.rates["good"][n][1] + (1 - self.share) * self.rates["bad"][n][-1]
            out[n] = right / (right + self.share * self.rates["good"][n][-1] + (1 - self.share) * self.rates["bad"][n][1])
        return out

    def fit(self, patterns: dict[tuple[int, ...], int], turns: int = 200, close: float = 1e-9) -> Model:
        total = sum(patterns.values())
        if not total:
            return self
        order = sorted(patterns)  # sums come out the same whatever the order of rows
        for _ in range(turns):
            good = {v: self.posterior(v) * patterns[v] for v in order}
            bad = {v: patterns[v] - good[v] for v in order}
            share = (sum(good.values()) + 0.04 * total) / (total * 1.05)
            for c, weight in (("good", good), ("bad", bad)):
                for k, n in enumerate(self.names):
                    got = {x: PRIOR[c][x] * total * (share if c == "good" else 1 - share) + sum(weight[v] for v in order if v[k] == x) for x in VOTES}
                    mass = sum(got.values())
                    self.rates[c][n] = {x: max(got[x] / mass, 1e-6) for x in VOTES}
            moved, self.share = abs(share - self.share), share
            if moved < close:
                break
        return self

    def column(self) -> Column:
        """The posterior as an expression over the rules' votes."""
        odds = F.lit(math.log(self.share) - math.log(1 - self.share))
        for n in self.names:
            weight = {v: math.log(self.rates["good"][n][v]) - math.log(self.rates["bad"][n][v]) for v in VOTES}
            odds += F.when(F.col(n) == 1, weight[1]).when(F.col(n) == -1, weight[-1]).otherwise(weight[0])
        return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame, good: float = GOOD) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, quality (the posterior), kept."""
    votes = rules()
    counted = cut(statistics(docs).withColumns(votes))  # narrow; texts are read once
    names = list(votes)
    patterns = {tuple(r[n] for n in names): r["count"] for r in counted.groupBy(*names).count().collect()}  # 3**rules rows at most
    model = Model(names).fit(patterns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("quality", model.column()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= good)).alias("kept"))


def filter(docs: DataFrame, good: float = GOOD) -> DataFrame:  # noqa: A001
    """The kept rows of docs, all columns. Rows travel with their votes, so counts are worked out once and texts aren't joined back."""
    votes = rules()
    names = list(votes)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col("text"))
    counted = cut(statistics(whole).withColumns(votes).select("doc_id", "n_words", "n_repeat_words", *names))
    patterns = {tuple(r[n] for n in names): r["count"] for r in counted.groupBy(*names).count().collect()}
    model = Model(names).fit(patterns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.where(~failed & (model.column() >= good)).select("doc_id.*")
