"""Sizes, ages and short forms for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "KMGTPE"


def human_bytes(n: Column) -> Column:
    """Steps of 1024, one decimal."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS, 1):
        value = F.format_string(f"%.1f {unit}B", F.bround(n.cast("double") / float(1024**k), 1))
        out = out.when(n < 1024 ** (k + 1), value) if k < len(UNITS) else out.otherwise(value)
    return out


def human_age(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days; a dash for none."""
    whole = lambda by, unit: F.concat(F.floor(seconds / by).cast("string"), F.lit(unit))
    return F.when(seconds.isNull() | (seconds <= 0), "—").when(seconds < 60, whole(1, "s")).when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def short_commit(commit: Column) -> Column:
    return F.when(F.coalesce(commit, F.lit("")) == "", "—").otherwise(F.substring(commit, 1, 7))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def rank_relevance(i: Column) -> Column:
    return F.greatest(F.lit(0.2), 0.9 - 0.08 * i)


# Folders of document types, in the legend's order.
KINDS = ("hld", "lld", "ears", "tasks", "research", "adr")


def kind_of_path(path: Column) -> Column:
    folder = F.regexp_extract(F.lower(path), r"(?:^|/)docs/(hld|lld|ears|tasks|research|adrs?|decisions)/", 1)
    adr = folder.isin("adr", "adrs", "decisions")
    return F.when(adr, "adr").when(folder != "", folder).when(F.lower(path).rlike(r"\.(md|mdx|markdown|txt|rst|adoc)$"), "doc").otherwise("code")
