"""The whole analysis record of each text, nested by section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import lexicon as lx
from inkspan.operators import features as ft

ANALYZER_VERSION = "0.1.0"

#: Section: (name in the section, column of the flat analysis).
SECTIONS = {
    "basic": [
        ("characters", "characters"), ("characters_no_spaces", "characters_no_spaces"), ("words", "words"), ("sentences", "sentences"), ("paragraphs", "paragraphs"), ("average_word_length", "average_word_length"),
        ("average_sentence_length", "average_sentence_length"), ("average_paragraph_length", "average_words_per_paragraph"), ("median_sentence_length", "median_sentence_length"), ("min_sentence_length", "min_sentence_length"), ("max_sentence_length", "max_sentence_length"),
    ],
    "sentence_structure": [
        ("count", "sentences"), ("average_length", "average_sentence_length"), ("median_length", "median_sentence_length"), ("min_length", "min_sentence_length"), ("max_length", "max_sentence_length"), ("standard_deviation", "sentence_deviation"),
        ("coefficient_of_variation", "sentence_variation"), ("short_ratio", "short_ratio"), ("medium_ratio", "medium_ratio"), ("long_ratio", "long_ratio"),
    ],
    "paragraph_structure": [
        ("count", "paragraphs"), ("average_words_per_paragraph", "average_words_per_paragraph"), ("median_words_per_paragraph", "median_words_per_paragraph"), ("min_words_per_paragraph", "min_words_per_paragraph"), ("max_words_per_paragraph", "max_words_per_paragraph"),
        ("words_std", "paragraph_deviation"), ("average_sentences_per_paragraph", "average_sentences_per_paragraph"), ("median_sentences_per_paragraph", "median_sentences_per_paragraph"), ("min_sentences_per_paragraph", "min_sentences_per_paragraph"), ("max_sentences_per_paragraph", "max_sentences_per_paragraph"),
    ],
    "vocabulary": [
        ("total_words", "words"), ("unique_words", "unique_words"), ("type_token_ratio", "type_token_ratio"), ("guiraud_r", "guiraud_r"), ("average_word_length", "vocabulary_word_length"), ("median_word_length", "median_word_length"),
        ("min_word_length", "min_word_length"), ("max_word_length", "max_word_length"), ("word_length_std", "word_length_deviation"),
    ],
    "punctuation": [("total", "punctuation_total"), ("punctuation_density", "punctuation_density")],
    "readability": [(x, x) for x in ft.READABILITY],
    "linguistic": [("total_words", "words"), ("pronoun_count", "pronoun_count"), ("pronoun_ratio", "pronoun_ratio"), ("transition_count", "transition_count"), *((x, x) for x in ft.UNMEASURED)],
}


def _pairs(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count")))


def analysis_records(df: DataFrame, text: str = "text", top_k: int = 20, character_ngrams: bool = False, char_n: int = 3, language: str = "en") -> DataFrame:
    """One row for each text that isn't null: its other columns and one struct for each section of the record."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if char_n < 1:
        raise ValueError("char_n must be at least 1")
    if not language.strip():
        raise ValueError("language must not be empty")

    inventories = {
        "_top_words": ("ngrams", 1, top_k), "_repeated_words": ("repeated", 3), "_bigrams": ("ngrams", 2, top_k), "_trigrams": ("ngrams", 3, top_k),
        "_pronoun_counts": ("pronouns",), "_transition_counts": ("connectives",), **({"_characters": ("characters", char_n, top_k)} if character_ngrams else {}),
    }
    keep = [c for c in df.columns if c != text]
    flat = ft.analyze(df, text, inventories=inventories)
    more = {
        "vocabulary": ["top_words", "repeated_words"],
        "linguistic": ["pronoun_counts", "transition_counts"],
    }
    marks = {"counts": "mark", "per_100_words": "per_100"}
    out = [F.struct(F.lit(ANALYZER_VERSION).alias("analyzer_version"), F.lit(language).alias("language")).alias("metadata")]
    for section, fields in SECTIONS.items():
        columns = [F.col(c).alias(n) for n, c in fields] + [_pairs(F.col(f"_{n}")).alias(n) for n in more.get(section, [])]
        if section == "punctuation":
            columns += [F.create_map(*(x for i, m in enumerate(lx.MARKS) for x in (F.lit(m), F.col(f"{c}_{i}")))).alias(n) for n, c in marks.items()]
        out.append(F.struct(*columns).alias(section))
    grams = [F.lit(top_k).alias("top_k"), _pairs(F.col("_bigrams")).alias("bigrams"), _pairs(F.col("_trigrams")).alias("trigrams")]
    if character_ngrams:
        grams.append(F.struct(F.lit(char_n).alias("n"), _pairs(F.col("_characters")).alias("ngrams")).alias("character_ngrams"))
    return flat.select(*keep, *out, F.struct(*grams).alias("ngrams"))
