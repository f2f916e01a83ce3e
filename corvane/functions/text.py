"""Tokens and stems."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: The combining marks that are left out of tokens. All others part them.
LEFT_OUT = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C, 0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330, 0x331)))


def _fold(letter: str) -> str:
    """A letter's folded form: its case folded, and without its mark if it is an ASCII letter with one."""
    small = next(x for x in (letter.casefold(), letter.lower(), letter.lower()[0]) if len(x) == 1)
    apart = unicodedata.normalize("NFD", small)
    return apart[0] if len(apart) == 2 and unicodedata.combining(apart[1]) and apart[0].isascii() else small


@functools.cache
def folding() -> tuple[str, str]:
    """All letters of the basic plane that fold to another, with what they fold to."""
    pairs = [(c, _fold(c)) for c in map(chr, (*range(0x41, 0xD800), *range(0xF900, 0xFFFE))) if unicodedata.category(c)[0] in "LN"]
    return "".join(c for c, f in pairs if c != f), "".join(f for c, f in pairs if c != f)


def folded(text: Column) -> Column:
    """Letters folded, and marks that are left out of tokens gone."""
    letters, forms = folding()
    return F.translate(F.coalesce(text, F.lit("")), letters + LEFT_OUT, forms)


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))


@functools.cache
def _folding_of_queries() -> dict[int, str | None]:
    return str.maketrans(*folding(), LEFT_OUT)


def tokens_of(text: str) -> list[str]:
    """The same on the driver, for queries."""
    flat = text.translate(_folding_of_queries())
    inside = lambda c: (kind := unicodedata.category(c))[0] in "LN" or kind == "Co"
    return "".join(c if inside(c) else " " for c in flat).split()


ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(text: Column | str) -> Column | str:
    """A-Z as a-z, all else as it is: a column, or a text on the driver."""
    return text.translate(str.maketrans(*ASCII)) if isinstance(text, str) else F.translate(text, *ASCII)


_VOWELS = "aeiou"


def _measure(word: str) -> tuple[int, str]:
    """The number of vowel-consonant turns, and the word written as v and c."""
    shape = ""
    for i, ch in enumerate(word):
        shape += "v" if ch in _VOWELS or (ch == "y" and i > 0 and shape[-1] == "c") else "c"
    return len(re.findall("v+c", re.sub("(.)\\1+", "\\1", shape))), shape


def _short(word: str, shape: str) -> bool:
    return len(word) > 2 and shape[-3:] == "cvc" and word[-1] not in "wxy"


# The suffixes of Porter's steps 2, 3 and 4.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, ends) -> str | None:
    return max((e for e in ends if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """Porter's stemmer, for ASCII words of three letters and more; others stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3])[0] > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _measure(w[:-2])[1]:
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _measure(w[:-3])[1]:
        w, again = w[:-3], True
    if again:
        count, shape = _measure(w)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and shape[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif count == 1 and _short(w, shape):
            w += "e"
    if w.endswith("y") and "v" in _measure(w[:-1])[1]:
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)])[0] > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, STEP4)
    if end:
        rest = w[: -len(end)]
        if _measure(rest)[0] > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e"):
        count, shape = _measure(w[:-1])
        if count > 1 or (count == 1 and not _short(w[:-1], shape)):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1])[0] > 1:
        w = w[:-1]
    return w


def stemmed(postings: DataFrame) -> DataFrame:
    """postings with their terms stemmed. Each distinct term is stemmed once, in Arrow batches, and joined back."""
    @F.pandas_udf("string")
    def stems(terms: pd.Series) -> pd.Series:
        return terms.map(stem)

    book = postings.select("term").distinct().select("term", stems("term").alias("stem"))
    return postings.join(book, "term").drop("term").withColumnRenamed("stem", "term")
