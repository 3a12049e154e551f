"""Drafts against profiles: metric rows, dimension and overall status.

Profiles are small (some 31 figures and 120 phrases for each author), but their
number grows with the authors, so no side is broadcast by hint: the optimiser
does that for the sizes it knows, and shuffles beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.functions import lexicon as lx
from inkspan.functions import text as tx
from inkspan.operators import profile as pf
from inkspan.sources.tables import materialise

CLOSE, MODERATE, SIGNIFICANT, UNAVAILABLE = "close", "moderately_different", "significantly_different", "unavailable"
LOW_WORDS, MEDIUM_WORDS = 100, 400
#: (dimension, metric, feature of the profile) of the numeric rows.
METRICS = [
    ("sentence_structure", "average_sentence_length", "sentence_structure.average_length"),
    ("sentence_structure", "median_sentence_length", "sentence_structure.median_length"),
    ("sentence_structure", "short_sentence_ratio", "sentence_structure.short_ratio"),
    ("sentence_structure", "medium_sentence_ratio", "sentence_structure.medium_ratio"),
    ("sentence_structure", "long_sentence_ratio", "sentence_structure.long_ratio"),
    ("paragraph_structure", "average_words_per_paragraph", "paragraph_structure.average_words_per_paragraph"),
    ("paragraph_structure", "average_sentences_per_paragraph", "paragraph_structure.average_sentences_per_paragraph"),
    ("paragraph_structure", "median_words_per_paragraph", "paragraph_structure.median_words_per_paragraph"),
    ("vocabulary", "vocabulary_diversity", "vocabulary.type_token_ratio"),
    ("vocabulary", "guiraud_r", "vocabulary.guiraud_r"),
    ("vocabulary", "average_word_length", "vocabulary.average_word_length"),
    ("vocabulary", "median_word_length", "vocabulary.median_word_length"),
    ("punctuation", "punctuation_density", "punctuation.punctuation_density"),
    *(("punctuation", f"punctuation_{m}_per_100", f"punctuation.{m}") for m in lx.MARKS),
    *(("readability", r, f"readability.{r}") for r in ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "automated_readability_index")),
    ("cohesion", "pronoun_ratio", "linguistic.pronoun_ratio"),
    ("cohesion", "transitions_per_100_words", "linguistic.transitions_per_100_words"),
]


def numeric_status(value: Column, mean: Column, std: Column, low: Column, high: Column) -> Column:
    """Inside the typical range; else by standard errors where the spread is usable; else by relative difference."""
    z = F.abs((value - mean) / std)
    relative = F.when(mean != 0, F.abs((value - mean) / mean)).otherwise(F.when(value == 0, 0.0).otherwise(float("inf")))
    return (
        F.when(value.isNull() | mean.isNull(), UNAVAILABLE)
        .when(low.isNotNull() & high.isNotNull() & value.between(low, high), CLOSE)
        .when(std > 1e-9, F.when(z <= 2, MODERATE).otherwise(SIGNIFICANT))
        .when(relative <= 0.2, CLOSE)
        .when(relative <= 0.4, MODERATE)
        .otherwise(SIGNIFICANT)
    )


def overlap_status(share: Column, size: Column) -> Column:
    return F.when(size == 0, UNAVAILABLE).when(share >= 0.5, CLOSE).when(share >= 0.2, MODERATE).otherwise(SIGNIFICANT)


def variation_label(variation: Column) -> Column:
    return F.when(variation.isNull(), None).when(F.abs(variation) < 0.15, "stable").when(F.abs(variation) < 0.35, "moderate").otherwise("variable")


def stability_status(draft: Column, profile: Column) -> Column:
    order = F.array(F.lit("stable"), F.lit("moderate"), F.lit("variable"))
    gap = F.abs(F.array_position(order, draft) - F.array_position(order, profile))
    return F.when(draft.isNull() | profile.isNull(), UNAVAILABLE).when(gap == 0, CLOSE).when(gap == 1, MODERATE).otherwise(SIGNIFICANT)


def score(status: Column) -> Column:
    return F.when(status == CLOSE, 0).when(status == MODERATE, 1).when(status == SIGNIFICANT, 2)


def mean_status(mean: Column) -> Column:
    return F.when(mean.isNull(), UNAVAILABLE).when(mean < 0.5, CLOSE).when(mean < 1.25, MODERATE).otherwise(SIGNIFICANT)


def numeric_rows(drafts: DataFrame, numbers: DataFrame, draft_keys: list[str], profile_key: str) -> DataFrame:
    """A row for each draft, profile and numeric metric.

    drafts: draft_keys, profile_key, feature, value; numbers: a profile's numeric aggregates.
    """
    spark = drafts.sparkSession
    catalog = F.broadcast(spark.createDataFrame(METRICS, "dimension string, metric string, feature string"))
    met = drafts.join(catalog, "feature").join(numbers, [profile_key, "feature"], "left")
    value = F.col("value")
    usable = F.col("std") > 1e-9
    return met.select(
        *draft_keys, profile_key, "dimension", "metric", tx.rounded(value).alias("draft_value"), F.col("mean").alias("profile_mean"), F.col("low"), F.col("high"),
        tx.rounded(value - F.col("mean")).alias("difference"), tx.rounded(F.when(usable, (value - F.col("mean")) / F.col("std"))).alias("z_score"), numeric_status(value, F.col("mean"), F.col("std"), F.col("low"), F.col("high")).alias("status"),
    )


def stability_rows(drafts: DataFrame, numbers: DataFrame, draft_keys: list[str], profile_key: str) -> DataFrame:
    """Variation of sentence and paragraph sizes against the profile's; drafts has both variations."""
    labels = numbers.where(F.col("feature").isin("sentence_structure.average_length", "paragraph_structure.average_words_per_paragraph")).select(profile_key, "feature", F.col("stability").alias("profile_label"))
    rows = F.array(
        F.struct(F.lit("sentence_structure").alias("dimension"), F.lit("sentence_length_variation").alias("metric"), F.lit("sentence_structure.average_length").alias("feature"), F.col("sentence_variation").alias("variation")),
        F.struct(F.lit("paragraph_structure").alias("dimension"), F.lit("paragraph_size_variation").alias("metric"), F.lit("paragraph_structure.average_words_per_paragraph").alias("feature"), F.col("paragraph_variation").alias("variation")),
    )
    long = drafts.select(*draft_keys, profile_key, F.explode(rows).alias("r")).select(*draft_keys, profile_key, "r.*")
    met = long.join(labels, [profile_key, "feature"], "left").withColumn("draft_label", variation_label(F.col("variation")))
    return met.select(*draft_keys, profile_key, "dimension", "metric", "draft_label", "profile_label", stability_status(F.col("draft_label"), F.col("profile_label")).alias("status"))


#: (dimension, metric, column of a sample_table) of the overlap rows.
OVERLAPS = [
    ("vocabulary", "shared_characteristic_terms", "words_list"),
    ("cohesion", "shared_connectives", "connectives"),
    ("ngrams", "common_bigrams", "bigrams"),
    ("ngrams", "common_trigrams", "trigrams"),
]


def wanted_phrases(samples: DataFrame, profile_key: str, sample: str, least_presence: float = 0.5) -> DataFrame:
    """One row for each profile with its recurring phrases: an array (rank, item, sample_presence) by column of the sample_table."""
    out = samples.select(profile_key).distinct()
    for _, _, column in OVERLAPS:
        found = pf.phrases_of(samples, [profile_key], column).where(F.col("sample_presence") >= least_presence)
        out = out.join(found.groupBy(profile_key).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "sample_presence"))).alias(column)), profile_key, "left")
    return out


def overlap_rows(drafts: DataFrame, wanted: DataFrame, draft_keys: list[str], profile_key: str) -> DataFrame:
    """How many of its profile's recurring phrases a draft has, four rows for each draft; they are counted within the row."""
    theirs = wanted.select(profile_key, *(F.col(c).alias(f"wanted_{c}") for _, _, c in OVERLAPS))
    met = drafts.select(*draft_keys, profile_key, "words", *(F.transform(c, lambda x: x["item"]).alias(c) for _, _, c in OVERLAPS)).join(theirs, profile_key, "left")

    def row(dimension: str, metric: str, column: str) -> Column:
        phrases = F.coalesce(F.col(f"wanted_{column}"), F.array().cast("array<struct<rank:bigint,item:string,sample_presence:double>>"))
        has = F.filter(phrases, lambda x: F.array_contains(F.col(column), x["item"]))

        def weight(a: Column) -> Column:
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["sample_presence"])

        return tx.let(F.struct(phrases.alias("all"), has.alias("has")), lambda p: F.struct(
            F.lit(dimension).alias("dimension"), F.lit(metric).alias("metric"), F.size(p["all"]).cast("long").alias("reference_size"), F.size(p["has"]).cast("long").alias("matched"),
            tx.rounded(F.when(F.size(p["all"]) > 0, F.size(p["has"]) / F.size(p["all"]))).alias("overlap"),
            tx.rounded(F.when(F.size(p["all"]) > 0, weight(p["has"]) / weight(p["all"]))).alias("weighted_overlap"),
            F.when(F.col("words") == 0, UNAVAILABLE).otherwise(overlap_status(F.size(p["has"]) / F.size(p["all"]), F.size(p["all"]))).alias("status"),
        ))

    rows = F.array(*(row(*x) for x in OVERLAPS))
    return met.select(*draft_keys, profile_key, F.explode(rows).alias("r")).select(*draft_keys, profile_key, "r.*")


def all_rows(drafts: DataFrame, samples: DataFrame, draft_keys: list[str], profile_key: str, sample: str) -> DataFrame:
    """Every numeric, stability and overlap row (37 for each draft), from sample_tables that were written out.

    A draft without words has all its rows, unavailable.
    """
    numbers = materialise(pf.profile_numbers(pf.long_features(samples, [profile_key]), [profile_key]), "numbers")
    return rows_against(drafts, numbers, wanted_phrases(samples, profile_key, sample), draft_keys, profile_key)


def rows_against(drafts: DataFrame, numbers: DataFrame, wanted: DataFrame, draft_keys: list[str], profile_key: str) -> DataFrame:
    """all_rows() for profiles that are there already, as numbers and recurring phrases."""
    kind = [*draft_keys, profile_key, "dimension", "metric", "status"]
    numeric = numeric_rows(pf.figures(drafts, [*draft_keys, profile_key]), numbers, draft_keys, profile_key)
    stable = stability_rows(with_variations(drafts), numbers, draft_keys, profile_key)
    shared = overlap_rows(drafts, wanted, draft_keys, profile_key)
    numeric = numeric.select(*kind, "draft_value", "low", "high", "difference")
    out = numeric.unionByName(stable.select(*kind), allowMissingColumns=True)
    return out.unionByName(shared.select(*kind, "matched", "reference_size"), allowMissingColumns=True)


def with_variations(drafts: DataFrame) -> DataFrame:
    return drafts.withColumn("paragraph_variation", F.when(F.col("average_words_per_paragraph") > 0, F.col("paragraph_deviation") / F.col("average_words_per_paragraph")))


def dimension_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dimension, how many rows could be compared, and their mean status."""
    g = rows.groupBy(*keys, "dimension").agg(F.count(score(F.col("status"))).alias("available"), F.avg(score(F.col("status"))).alias("mean_score"))
    return g.select(*keys, "dimension", "available", tx.rounded(F.col("mean_score")).alias("mean_score"), mean_status(F.col("mean_score")).alias("status"))


def check_weights(weights: dict[str, float] | None) -> dict[str, float]:
    unknown = sorted(set(weights or {}) - set(lx.DIMENSION_WEIGHTS))
    if unknown:
        raise ValueError(f"unknown dimensions: {unknown}")
    for name, w in (weights or {}).items():
        if not isinstance(w, (int, float)) or w < 0:
            raise ValueError(f"the weight of {name} must be a number that isn't negative")
    return lx.DIMENSION_WEIGHTS | (weights or {})


def overall_status(dimensions: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The weighted mean of the dimensions that could be compared."""
    w = F.lit(0.0)
    for name, value in check_weights(weights).items():
        w = F.when(F.col("dimension") == name, float(value)).otherwise(w)
    s = score(F.col("status"))
    g = dimensions.groupBy(*keys).agg((F.sum(s * w) / F.nullif(F.sum(F.when(s.isNotNull(), w)), F.lit(0.0))).alias("mean"))
    return g.select(*keys, tx.rounded(F.col("mean")).alias("mean_score"), mean_status(F.col("mean")).alias("status"))


def comparison_confidence(profile_level: Column, draft_words: Column) -> Column:
    rank = F.least(F.when(profile_level == "low", 0).when(profile_level == "medium", 1).otherwise(2), F.when(draft_words < LOW_WORDS, 0).when(draft_words < MEDIUM_WORDS, 1).otherwise(2))
    return F.when(rank == 0, "low").when(rank == 1, "medium").otherwise("high")


def context_note(profile_context: Column, draft_context: Column) -> Column:
    note = F.format_string("Context mismatch: profile is '%s' writing but the draft is labeled '%s'; stylistic differences may reflect context, not inconsistency.", profile_context, draft_context)
    return F.when((draft_context != "") & (draft_context != profile_context), note)


def worst_metrics(rows: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """The k strongest deviations of each dimension: significant ones first, then by name."""
    bad = rows.where(F.col("status").isin(SIGNIFICANT, MODERATE))
    order = Window.partitionBy(*keys, "dimension").orderBy(F.desc(score(F.col("status"))), "metric")
    return bad.select(*keys, "dimension", "metric", "status").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
