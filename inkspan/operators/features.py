"""Measurements of each text in one pass, without a shuffle; figures that aren't whole numbers are rounded to four places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import lexicon as lx
from inkspan.functions import reading as rd
from inkspan.functions import text as tx
from inkspan.operators.scan import WHOLE, scan

READABILITY = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "automated_readability_index"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


MARKS = tuple(f"mark_{i}" for i in range(len(lx.MARKS)))


def measure(df: DataFrame, text: str = "text", normalize: bool = False, only: set[str] | None = None, inventories: dict[str, tuple] | None = None) -> DataFrame:
    """df without its text, with a column m of the measurements (unrounded) and scan()'s inventories; only what `only` needs is computed."""
    return scan(df, text, [n for n in rd.MEASURES if only is None or n in only], inventories, normalize)


def per_100(count: Column, words: Column) -> Column:
    return F.when(words > 0, count / words * 100)


#: Of the analysis record, what a language model would be needed for: always null.
UNMEASURED = ("nouns", "verbs", "adjectives", "adverbs", "named_entities")


def _total(m: Column) -> Column:
    return sum((m[x] for x in MARKS), F.lit(0))


#: Columns of the analysis record that are made from several measurements.
COMPOSED = {
    **{f"per_100_{i}": ((x, "words"), lambda m, x=x: tx.rounded(per_100(m[x], m["words"]))) for i, x in enumerate(MARKS)},
    "punctuation_total": (MARKS, _total),
    "punctuation_density": ((*MARKS, "words"), lambda m: tx.rounded(_ratio(_total(m), m["words"]))),
    "pronoun_ratio": (("pronoun_count", "words"), lambda m: tx.rounded(_ratio(m["pronoun_count"], m["words"]))),
}


def analyze(df: DataFrame, text: str = "text", normalize: bool = True, only: list[str] | None = None, inventories: dict[str, tuple] | None = None) -> DataFrame:
    """One row for each text: its other columns and the rounded analysis record, nothing of the text itself.

    With `only`, of the record these columns alone; nothing else is computed.  scan()'s inventories are made in the same pass.
    """
    names = [*rd.MEASURES, *COMPOSED, *UNMEASURED] if only is None else only
    needed = {x for n in names for x in (COMPOSED[n][0] if n in COMPOSED else (n,))}
    keep = [c for c in df.columns if c != text]
    m = F.col("m")  # extracting fields of m must not recompute it

    def column(n: str) -> Column:
        if n in COMPOSED:
            return COMPOSED[n][1](m)
        if n in UNMEASURED:
            return F.lit(None).cast("long")
        return m[n] if n in WHOLE else tx.rounded(m[n])

    return measure(df, text, normalize, needed, inventories).select(*keep, *(column(n).alias(n) for n in names), *(inventories or ()))
