"""Writing profiles: aggregates over the texts of an author.

Numeric aggregates are made from the analysis record's rounded figures.  They
are added up by (author, feature, value) first, so an author with a third of
all rows is spread over all tasks, and the exact median of the second step sees
distinct rounded values with their counts, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import lexicon as lx
from inkspan.functions import text as tx
from inkspan.operators import features as ft
from inkspan.sources.tables import materialise

#: feature of a profile -> column of the analysis record.
FEATURES = {
    "sentence_structure.average_length": "average_sentence_length",
    "sentence_structure.median_length": "median_sentence_length",
    "sentence_structure.short_ratio": "short_ratio",
    "sentence_structure.medium_ratio": "medium_ratio",
    "sentence_structure.long_ratio": "long_ratio",
    "paragraph_structure.average_words_per_paragraph": "average_words_per_paragraph",
    "paragraph_structure.average_sentences_per_paragraph": "average_sentences_per_paragraph",
    "paragraph_structure.median_words_per_paragraph": "median_words_per_paragraph",
    "vocabulary.type_token_ratio": "type_token_ratio",
    "vocabulary.guiraud_r": "guiraud_r",
    "vocabulary.average_word_length": "vocabulary_word_length",
    "vocabulary.median_word_length": "median_word_length",
    "punctuation.punctuation_density": "punctuation_density",
    **{f"punctuation.{m}": f"per_100_{i}" for i, m in enumerate(lx.MARKS)},
    **{f"readability.{r}": r for r in ft.READABILITY},
    "linguistic.pronoun_ratio": "pronoun_ratio",
    "linguistic.transitions_per_100_words": "transitions_per_100_words",
}
STABILITY_OF = {"vocabulary.type_token_ratio": "diversity", "sentence_structure.average_length": "length", "paragraph_structure.average_words_per_paragraph": "size"}
TOP_N = 30
CONTEXTS = ("general", "academic", "technical", "casual")


def sample_weight(words: Column) -> Column:
    return F.sqrt(F.greatest(words, F.lit(1)).cast("double"))


def with_rates(analysis: DataFrame) -> DataFrame:
    """The transition rate is of unrounded counts."""
    return analysis.withColumn("transitions_per_100_words", F.when(F.col("words") > 0, F.col("transition_count") / F.col("words") * 100))


def figures(analysis: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature and value: one row for each figure of each text; a text without words has null values."""
    rows = F.array(*(F.struct(F.lit(name).alias("feature"), F.col(c).cast("double").alias("value")) for name, c in FEATURES.items()))
    return with_rates(analysis).select(*keys, F.explode(rows).alias("f")).select(*keys, "f.feature", "f.value")


def long_features(analysis: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, value and weight: one row for each figure of each sample with words.

    Samples without words are left out behind the generator: a filter on the words would be pushed below the
    analysis, which then would be made twice.
    """
    rows = F.array(*(F.struct(F.lit(name).alias("feature"), F.col(c).cast("double").alias("value")) for name, c in FEATURES.items()))
    some = with_rates(analysis).select(*keys, sample_weight(F.col("words")).alias("weight"), F.explode_outer(F.when(F.col("words") > 0, rows)).alias("f"))
    return some.where("f is not null").select(*keys, "f.feature", "f.value", "weight")


def numeric_aggregates(features: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean; unweighted median, deviation, least, greatest and count; unusable figures are skipped."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    counted = features.withColumn("value", finite).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("times"), F.sum("weight").alias("weights"))
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("times"))
    total = F.sum(n)
    mean = F.sum(v * n) / total
    grouped = counted.groupBy(*by, "feature").agg(
        (F.sum(v * F.col("weights")) / F.sum(F.when(v.isNotNull(), F.col("weights")))).alias("mean"),
        F.expr("percentile(value, 0.5, times)").alias("median"),
        F.when(total > 0, F.sqrt(F.greatest(F.sum(v * v * n) / total - mean * mean, F.lit(0.0)))).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(total, F.lit(0)).alias("n"),
    )
    return grouped.withColumn("low", F.col("mean") - F.col("std")).withColumn("high", F.col("mean") + F.col("std"))


def stability(mean: Column, std: Column) -> Column:
    spread = F.abs(std / mean)
    return F.when(mean.isNull() | std.isNull(), None).when(mean == 0, F.when(std == 0, "stable").otherwise("variable")).when(spread < 0.15, "stable").when(spread < 0.35, "moderate").otherwise("variable")


def profile_numbers(features: DataFrame, by: list[str]) -> DataFrame:
    """The profile's numeric part: rounded aggregates, and the stability of those that have one."""
    a = numeric_aggregates(features, by)
    label = F.when(F.col("feature").isin(*STABILITY_OF), stability(F.col("mean"), F.col("std")))
    return a.select(*by, "feature", *(tx.rounded(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max", "low", "high")), "n", label.alias("stability"))


def _rated(found: DataFrame, by: list[str], top_n: int) -> DataFrame:
    """The top_n phrases of each author, those in most samples first: total count, mean rate in the samples that have one, share of samples that do.

    found: by, words and items (item, count, rank) of each sample.  A sample's row without item counts the sample, so all is
    read once: it comes first in its author's order and gives the number of samples to the phrases that are left.
    """
    sample = F.array(F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("rank")))
    rows = found.where("words > 0").select(*by, "words", F.explode(F.concat(sample, "items")).alias("x")).select(*by, "x.item", "x.count", "words")
    g = rows.groupBy(*by, "item").agg(F.sum("count").alias("count"), (F.sum(F.col("count") / F.col("words")) / F.count(F.lit(1))).alias("frequency"), F.count(F.lit(1)).alias("holders"))
    order = Window.partitionBy(*by).orderBy(F.col("item").isNotNull(), F.desc("holders"), F.desc("order_frequency"), "item")
    first = g.withColumn("order_frequency", F.round(F.col("frequency").cast("decimal(20,12)"), 10)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n + 1)
    shared = first.withColumn("samples", F.max(F.when(F.col("item").isNull(), F.col("holders"))).over(Window.partitionBy(*by))).where("item is not null")
    return shared.select(*by, "item", "count", tx.rounded(F.col("frequency")).alias("frequency"), tx.rounded(F.col("holders") / F.col("samples")).alias("sample_presence"), (F.col("rank") - 1).alias("rank"))


def confidence_level(samples: Column, words: Column) -> Column:
    return F.when((samples < 2) | (words < 500), "low").when((samples >= 4) & (words >= 1500), "high").otherwise("medium")


def profile_metadata(analysis: DataFrame, by: list[str]) -> DataFrame:
    g = analysis.groupBy(*by).agg(F.count_if(F.col("words") > 0).alias("sample_count"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.count_if(F.col("words") == 0).alias("skipped_samples"))
    return g.where("sample_count > 0").withColumn("confidence", confidence_level(F.col("sample_count"), F.col("total_words")))


def outliers(analysis: DataFrame, by: list[str], sample: str, least: int = 4) -> DataFrame:
    """Samples whose average sentence length or word count is more than two deviations from the author's mean."""
    rows = F.array(F.struct(F.lit("average_sentence_length").alias("feature"), F.col("average_sentence_length").alias("value")), F.struct(F.lit("word_count").alias("feature"), F.col("words").cast("double").alias("value")))
    v = analysis.select(*by, sample, F.explode_outer(F.when(F.col("words") > 0, rows)).alias("f")).where("f.value is not null").select(*by, sample, "f.feature", "f.value")
    moments = v.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).where((F.col("k") >= least) & (F.col("std") > 0))
    z = v.join(moments, [*by, "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))
    return z.where(F.abs("z") > 2).select(*by, sample, "feature", "value", tx.rounded(F.col("z")).alias("z_score"))


def structural_notes(analysis: DataFrame, by: list[str]) -> DataFrame:
    def mean(c: str) -> Column:
        return F.avg(F.when(F.col("words") > 0, F.col(c)))

    m = analysis.groupBy(*by).agg(mean("short_ratio").alias("short"), mean("long_ratio").alias("long"), mean("average_sentences_per_paragraph").alias("para"), F.count_if(F.col("words") > 0).alias("samples")).where("samples > 0")
    notes = F.array_compact(F.array(F.when(F.col("short") > 0.5, "majority of sentences are short"), F.when(F.col("long") > 0.5, "majority of sentences are long"), F.when(F.col("para") <= 2.5, "typically short paragraphs").when(F.col("para") >= 6, "typically long paragraphs")))
    return m.select(*by, notes.alias("structural_notes"))


def sample_table(df: DataFrame, text: str = "text", top_k: int = 50) -> DataFrame:
    """One row for each text, without the text: its other columns, the analysis record and the inventories.

    words_list, bigrams and trigrams are the top_k most frequent (item, count, rank), connectives all that occur.
    All that profiles and comparisons need, made in one pass; write it out where more than one reads it.
    """
    inventories = {"words_list": ("ngrams", 1, top_k), "bigrams": ("ngrams", 2, top_k), "trigrams": ("ngrams", 3, top_k), "connectives": ("connectives",)}
    return ft.analyze(df, text, inventories=inventories)


def phrases_of(table: DataFrame, by: list[str], column: str, top_k: int = 30, top_n: int = TOP_N) -> DataFrame:
    """The phrases of a sample_table's column that recur in the samples' top_k lists."""
    lists = F.slice(F.col(column), 1, top_k) if column != "connectives" else F.col(column)
    return _rated(table.select(*by, "words", lists.alias("items")), by, top_n)


def feature_coverage(features: DataFrame, by: list[str]) -> DataFrame:
    """On how many samples each figure rests."""
    n = features.groupBy(*by, "feature").agg(F.count("value").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "n")))).alias("feature_coverage"))


def common_phrases(df: DataFrame, by: list[str], n: int, top_k: int = 30, top_n: int = TOP_N, text: str = "text") -> DataFrame:
    """Words (n = 1) or word n-grams that recur in the samples' top_k lists."""
    return _rated(ft.analyze(df.select(*by, text), text, only=["words"], inventories={"items": ("ngrams", n, top_k)}), by, top_n)


def common_connectives(df: DataFrame, by: list[str], top_n: int = TOP_N, text: str = "text") -> DataFrame:
    return _rated(ft.analyze(df.select(*by, text), text, only=["words"], inventories={"items": ("connectives",)}), by, top_n)


def build_profiles(df: DataFrame, by: str = "author", sample: str = "sample_index", text: str = "text", context: str = "general", language: str = "en", top_k: int = 30) -> DataFrame:
    """One row for each author: metadata, numbers, phrases, notes and outliers as nested columns; no text."""
    if context not in CONTEXTS:
        raise ValueError(f"context must be one of {CONTEXTS}")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return profiles_of(materialise(sample_table(df.select(by, sample, text), text, top_k), "samples"), by, sample, context, language, top_k)


def profiles_of(table: DataFrame, by: str = "author", sample: str = "sample_index", context: str = "general", language: str = "en", top_k: int = 30) -> DataFrame:
    """build_profiles() of a sample_table that was written out; the texts are read no more."""
    keys = [by]
    features = long_features(table, keys)
    numbers = profile_numbers(features, keys).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct("mean", "median", "std", "min", "max", "n", "low", "high", "stability"))))).alias("numbers"))
    out = profile_metadata(table, keys).withColumn("context", F.lit(context)).withColumn("language", F.lit(language.lower())).join(numbers, by, "left").join(feature_coverage(features, keys), by, "left")
    phrase = F.array_sort(F.collect_list(F.struct("rank", "item", "count", "frequency", "sample_presence")))
    for name, column in (("common_terms", "words_list"), ("common_bigrams", "bigrams"), ("common_trigrams", "trigrams"), ("common_connectives", "connectives")):
        out = out.join(phrases_of(table, keys, column, top_k).groupBy(by).agg(phrase.alias(name)), by, "left")
    out = out.join(structural_notes(table, keys), by, "left")
    notes = outliers(table, keys, sample).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("feature", sample, "value", "z_score"))).alias("outlier_notes"))
    out = out.join(notes, by, "left").withColumn("profile_version", F.lit("0.1.0"))
    repeated = F.filter("common_trigrams", lambda x: x["sample_presence"] >= 0.5)
    return out.withColumn("patterns", F.struct(repeated.alias("repeated_phrases"), F.transform(F.slice(F.coalesce("common_connectives", F.array()), 1, 10), lambda x: x["item"]).alias("recurring_connectives")))
