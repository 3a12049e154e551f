"""Column functions for text: segmentation, counts, extraction and rounding.

All but nfkc() are built-in expressions, so they stay in the JVM.  let() binds
an expression that several others use, so it is computed once for each row.
What reads whole texts, functions/reading.py does by the same rules in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import lexicon as lx

_SPACE = r"[\s\x1c-\x1f]"
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"
_ABBREVIATION = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
_DOTTED = r"[A-Za-z](?:\.[A-Za-z.]{0,3}|[A-Za-z.]\.[A-Za-z.]{0,2}|[A-Za-z.]{2}\.[A-Za-z.]?|[A-Za-z.]{3}\.)[A-Za-z]"
_NOT_ABBREVIATED = rf"(?<!(?:^|[^A-Za-z.])\.{{0,24}}(?:(?i:{_ABBREVIATION})|{_DOTTED}))"
_FOLLOWED = rf"{_SPACE}+(?=[\"'“”‘’(\[]*[A-Z0-9])"
#: The cheap tests stand first, so the lookbehind runs at few places.
SENTENCE_END = rf"(?U)(?=[.!?…])(?<![.!?…])(?:(?=[!?…])|(?=[.!?…]+{_SPACE}+[\"'“”‘’(\[]*[A-Z0-9]){_NOT_ABBREVIATED})([.!?…]+){_FOLLOWED}"
_CUT = "\x01"
VOWELS = "[aeiouy]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def lines(text: Column) -> Column:
    """Line ends as \\n."""
    return F.regexp_replace(text, "\r\n?", "\n")


def nfkc(text: Column) -> Column:
    """NFKC and \\n; there is no built-in NFKC, so texts beyond ASCII pass an Arrow function."""
    return lines(F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_WHITE))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(lx.WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(lx.WORD))


def lowered(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"(?U)\n{_SPACE}*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    cut = F.split(F.regexp_replace(strip(text), SENTENCE_END, f"$1{_CUT}"), _CUT)
    return F.filter(F.transform(cut, strip), lambda s: s.rlike(lx.WORD))


def length_without_space(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, rf"(?U){_SPACE}", ""))


def occurrences(text: Column, mark: str) -> Column:
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def mark_count(text: Column, mark: str) -> Column:
    found = occurrences(text, mark)
    if mark == '"':
        for q in lx.CURLY_QUOTES:
            found = found + occurrences(text, q)
    return found


def syllables(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")

    def count(w: Column) -> Column:
        stem = F.when(w.endswith("e") & ~w.endswith("le"), F.left(w, F.char_length(w) - 1)).otherwise(w)
        groups = F.regexp_count(stem, F.lit(VOWELS))
        fewer = F.when((w.endswith("es") | w.endswith("ed")) & (groups > 1), groups - 1).otherwise(groups)
        return F.when(w == "", 0).when(F.char_length(w) <= 3, 1).otherwise(F.greatest(fewer, F.lit(1)))

    return let(letters, count)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(lx.NUMBER), F.lit(0)))


def citations(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in lx.CITATIONS]
    return F.array_union(F.array_union(found[0], found[1]), found[2])


def has_evasion_intent(request: Column) -> Column:
    low = F.lower(F.coalesce(request, F.lit("")))
    return F.exists(F.array(*map(F.lit, lx.EVASION_PHRASES)), lambda p: F.contains(low, p))


def rounded(x: Column) -> Column:
    """Four places, ties away from zero on the decimal value."""
    return F.round(x.cast("decimal(18,8)"), 4).cast("double")


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def median_of(a: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    return let(F.array_sort(a), middle)


def deviation_of(a: Column) -> Column:
    """Population standard deviation; 0 for one value."""

    def spread(m: Column) -> Column:
        return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))

    return let(mean_of(a), spread)
