"""Frequency inventories of each text: words, word n-grams, character n-grams, connectives.

Whole texts are counted by listed(), in Python; the functions of columns are for arrays that are there already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import lexicon as lx
from inkspan.functions import text as tx
from inkspan.operators.scan import scan


def word_ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens

    def runs(t: Column) -> Column:
        size = F.size(t) - (n - 1)
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return tx.let(tokens, runs)


def char_ngrams(text: Column, n: int) -> Column:
    def cut(s: Column) -> Column:
        size = F.char_length(s) - (n - 1)
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return tx.let(tx.strip(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " ")), cut)


def counted(items: Column) -> Column:
    """The distinct items of an array with their counts and first places, by item; sorted and cut within the row, so nothing is shuffled."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("first_pos"))))

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["item"] != F.get(s, i - 1)["item"]), i)), lambda i: i.isNotNull())
        return tx.let(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i)["item"].alias("item"), (F.coalesce(F.get(at, k + 1), n) - i).cast("long").alias("count"), F.get(s, i)["first_pos"].alias("first_pos"))))

    return tx.let(placed, runs)


def most_frequent(items: Column, k: int) -> Column:
    """The k most frequent items of an array with count and rank; ties go to the item that comes first."""
    ranked = F.sort_array(F.transform(counted(items), lambda x: F.struct((-x["count"]).alias("less"), x["first_pos"].alias("first_pos"), x["item"].alias("item"))))
    return F.transform(F.slice(ranked, 1, k), lambda x, i: F.struct(x["item"].alias("item"), (-x["less"]).alias("count"), (i + 1).cast("long").alias("rank")))


def top_items(df: DataFrame, items: Column, keys: list[str], k: int) -> DataFrame:
    """keys, item, count and rank of each text's k most frequent items."""
    return df.select(*keys, F.explode_outer(most_frequent(items, k)).alias("x")).where("x is not null").select(*keys, "x.item", "x.count", "x.rank")


def repeated_items(df: DataFrame, items: Column, keys: list[str], least: int = 3) -> DataFrame:
    found = F.filter(counted(items), lambda x: x["count"] >= least)
    return df.select(*keys, F.explode_outer(found).alias("x")).where("x is not null").select(*keys, "x.item", "x.count")


def tokens_of(text: Column) -> Column:
    return tx.lowered(tx.words(tx.nfkc(text)))


def listed(df: DataFrame, kind: tuple, keys: list[str], text: str = "text") -> DataFrame:
    """keys, item, count and rank of each text's inventory, one of reading.INVENTORIES with its parameters."""
    return scan(df.select(*keys, text), text, [], {"x": kind}).select(*keys, F.explode("x").alias("x")).select(*keys, "x.item", "x.count", "x.rank")


def connective_counts(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, item and count of each text's connectives, counted in the joined words without overlap."""
    return listed(df, ("connectives",), keys, text).drop("rank")
