"""Text functions on built-in expressions.

Java's ``\\w`` knows ASCII only, so word characters are spelled out as ``[\\p{L}\\p{N}_]``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import stem

#: English stop words of the BM25 tokeniser.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Patterns of contents lines, page footers and rule headings.
CONTENTS_LINE = r"\.{4,}\s*\d+\s*$"
PAGE_FOOTER = r"(?i)^\s*(page\s+\d+\s+of\s+\d+|\d{1,3})\s*$"
RULE_HEADING = r"(?m)(?=^(?:RULE\s+\d+[:.]?|G\d{1,3}\b))"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column) -> Column:
    """Line ends, words hyphenated over lines, runs of blanks and of empty lines, ends."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"({WORD})-\n({WORD})", "$1$2")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def fold_for_match(c: Column) -> Column:
    """For comparing quotations: plain quotes and dashes, single blanks, lower case."""
    c = F.translate(c, "‘’“”–—\u00a0", "''\"\"-- ")
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def nfkd(c: Column) -> Column:
    @F.pandas_udf("string")
    def decompose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return decompose(c)


def match_normalise(c: Column) -> Column:
    """fold_for_match after compatibility decomposition, for which Spark has no expression."""
    return fold_for_match(nfkd(c))


def mask_digits(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\d+", "#"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def filled_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def is_front_matter(c: Column, share: float = 0.30, least: int = 5) -> Column:
    """Covers (fewer than ``least`` lines) and pages of contents."""
    body = F.filter(lines(c), lambda x: strip(x) != "")
    contents = F.size(F.filter(body, lambda x: F.regexp_like(x, F.lit(CONTENTS_LINE))))
    return (F.size(body) < least) | F.coalesce(F.try_divide(contents, F.size(body)) >= share, F.lit(False))


def is_clean(c: Column, least: int = 200) -> Column:
    """Enough text, no marks of failed decoding, words of three letters or more in the mean."""
    body = strip(c)
    words = F.regexp_extract_all(body, F.lit(r"([A-Za-z]{2,})"), F.lit(1))
    mean = F.try_divide(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)), F.size(words))
    return (F.length(body) >= least) & ~F.contains(body, F.lit("�")) & ~F.contains(body, F.lit("\0")) & F.coalesce(mean >= 3.0, F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-cased words of two characters or more without stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}{{2,}})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def words(c: Column) -> Column:
    """Tokens for counting and cutting: runs without white space."""
    return F.filter(F.split(c, r"\s+", -1), lambda t: t != "")


def round6(c: Column) -> Column:
    """Half up at six places, the same in every engine."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def stemmed(c: Column) -> Column:
    """The stems of words, one for one; each distinct word of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def stems(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        kind = words.dictionary.type
        values = pa.array([stem(w) for w in words.dictionary.to_pylist()], kind).take(words.indices)
        lengths = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pa.concat_arrays([pa.array([0], lengths.type), pc.cumulative_sum(lengths)])
        return type(lists).from_arrays(ends, values, mask=lists.is_null())

    return stems(c)
