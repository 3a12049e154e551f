"""Revisions: what must be kept, response parsing, prompts, and a batch loop over a provider."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import text as tx
from inkspan.operators.scan import part_rows
from inkspan.sources.tables import materialise

MIN_RATIO, MAX_RATIO, MIN_SIMILARITY = 0.3, 3.0, 0.25
MOST_CHARS, MOST_ATTEMPTS = 50_000, 3
MODES = ("conservative", "balanced", "expressive")
#: What each mode asks for, in this package's own words.
GUIDANCE = {
    "conservative": "Change as few words as the request and the differences below call for, and leave the order of things alone.",
    "balanced": "Reword whole sentences where they miss the profile, and leave those alone that don't.",
    "expressive": "Rewrite freely in the manner of the profile, as long as the same things are said.",
}
RESPONSE = "revised_text string, change_summary array<struct<dimension: string, description: string, importance: string>>"


#: Pairs are taken from their Arrow batch in parts of so many bytes, so a worker holds the words of no more.
PART_BYTES = 1 << 20


def _similarity(a: str | None, b: str | None) -> float:
    x, y = (a or "").split(), (b or "").split()
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else float(not x and not y)


@F.arrow_udf(T.DoubleType())
def similarity(original: pa.Array, revised: pa.Array) -> pa.Array:
    """Matching-block ratio of white-space words; no built-in measures this."""
    out, at = [], 0
    while at < len(original):
        size = part_rows([original, revised], at, PART_BYTES)
        out += map(_similarity, original.slice(at, size).to_pylist(), revised.slice(at, size).to_pylist())
        at += size
    return pa.array(out, pa.float64())


@F.pandas_udf(T.StringType())
def unified_diff(original: pd.Series, revised: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "original", "revised", lineterm="")) for a, b in zip(original, revised, strict=True)])


def lost(found: Column, revised: Column) -> Column:
    """Values of the original that the revision doesn't contain, sorted."""
    return F.array_sort(F.filter(found, lambda x: ~F.contains(revised, x)))


def length_ratio(original: Column, revised: Column) -> Column:
    n = tx.word_count(original)
    return F.when(n > 0, tx.word_count(revised) / n)


def dropped_terms(terms: Column, original: Column, revised: Column) -> Column:
    """Longer alphabetic terms of the original that are gone, at most ten."""
    low = F.struct(F.lower(original).alias("original"), F.lower(revised).alias("revised"))
    gone = tx.let(low, lambda p: F.filter(terms, lambda t: (F.char_length(t) > 3) & t.rlike(r"^[\p{L}]+$") & F.contains(p["original"], t) & ~F.contains(p["revised"], t)))
    return F.slice(gone, 1, 10)


# How failures begin, which a retry's prompt repeats.
EMPTY, NUMBERS, CITATIONS, LENGTH, OTHER = "empty revision", "lost numerical values: ", "lost citation markers: ", "excessive length change", "revision is unrecognizable as the same document"


def hard_checks(pairs: DataFrame, original: str = "original", revised: str = "revised") -> DataFrame:
    """pairs with each hard constraint's figures and failures; passed says whether none failed."""
    o, r = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(revised), F.lit(""))
    out = pairs.withColumns({"lost_numbers": lost(tx.numbers(o), r), "lost_citations": lost(tx.citations(o), r), "length_ratio": length_ratio(o, r), "similarity": similarity(o, r)})
    ratio = F.col("length_ratio")
    failures = F.array_compact(F.array(
        F.when(F.size("lost_numbers") > 0, F.concat(F.lit(NUMBERS), F.array_join(F.slice("lost_numbers", 1, 10), ", "))),
        F.when(F.size("lost_citations") > 0, F.concat(F.lit(CITATIONS), F.array_join(F.slice("lost_citations", 1, 10), ", "))),
        F.when((ratio < MIN_RATIO) | (ratio > MAX_RATIO), F.format_string(f"{LENGTH} (ratio %.2f)", ratio)),
        F.when(F.col("similarity") < MIN_SIMILARITY, F.format_string(f"{OTHER} (similarity %.2f)", F.col("similarity"))),
    ))
    failures = F.when(tx.strip(r) == "", F.array(F.lit(EMPTY))).otherwise(failures)
    return out.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def status_rank(status: Column) -> Column:
    return F.when(status == "close", 0).when(status == "moderately_different", 1).when(status == "significantly_different", 2)


def drifted(before: Column, after: Column) -> Column:
    return F.coalesce(status_rank(after) > status_rank(before), F.lit(False))


def validate_revision(pairs: DataFrame, original: str = "original", revised: str = "revised") -> DataFrame:
    """hard_checks() with warnings and drift: of dropped characteristic terms, and of a status farther from the profile.

    pairs: original, revised, terms (array), status_before and status_after (null where not compared).
    """
    out = hard_checks(pairs, original, revised)
    gone = F.transform(dropped_terms(F.coalesce("terms", F.array().cast("array<string>")), F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(revised), F.lit(""))), lambda t: F.concat(F.lit("dropped characteristic term: "), t))
    away = drifted(F.col("status_before"), F.col("status_after"))
    drift = F.when(away, F.concat(F.lit("style drift away from the profile: "), F.col("status_before"), F.lit(" to "), F.col("status_after")))
    empty = F.array_contains("failures", EMPTY)
    out = out.withColumn("drift", F.struct(F.col("status_before").alias("before"), F.col("status_after").alias("after"), away.alias("drifted")))
    return out.withColumn("warnings", F.concat(F.when(empty, F.array().cast("array<string>")).otherwise(gone), F.array_compact(F.array(drift))))


def characteristic_terms(terms: DataFrame, connectives: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Terms that all samples have, then connectives, without repeats, the first `limit`."""
    both = terms.select(key, F.lit(0).alias("part"), "rank", "item", "sample_presence").unionByName(connectives.select(key, F.lit(1).alias("part"), "rank", "item", "sample_presence")).where("sample_presence >= 1.0")
    first = both.groupBy(key, "item").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), 1, limit).alias("terms"))


def parse_response(response: Column) -> Column:
    """The revised text of a response: JSON's revised_text, or the plain text; empty if blank or malformed."""
    clean = tx.strip(F.coalesce(response, F.lit("")))
    return F.when(clean.startswith("{"), F.coalesce(F.from_json(clean, RESPONSE)["revised_text"], F.lit(""))).otherwise(clean)


def parse_changes(response: Column) -> Column:
    """Change summaries with a description; importance is medium unless high, medium or low."""
    raw = F.coalesce(F.from_json(tx.strip(response), RESPONSE)["change_summary"], F.array())
    kept = F.filter(raw, lambda c: F.coalesce(c["description"], F.lit("")) != "")
    return F.transform(kept, lambda c: F.struct(F.coalesce(c["dimension"], F.lit("general")).alias("dimension"), c["description"].alias("description"), F.when(c["importance"].isin("high", "medium", "low"), c["importance"]).otherwise("medium").alias("importance")))


def input_errors(draft: Column, request: Column) -> Column:
    return F.when(F.coalesce(tx.strip(draft), F.lit("")) == "", "draft is empty").when(F.char_length(draft) > MOST_CHARS, "draft is too long").when(tx.has_evasion_intent(request), "requests for detector evasion are refused")


def prompt(draft: Column, profile: Column, comparison: Column, request: Column, mode: str = "conservative", notes: Column | None = None) -> Column:
    """Five delimited sections; data sections are marked as data, not instructions."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rules = F.lit(f"INSTRUCTIONS ({mode}): revise the draft towards the profile. {GUIDANCE[mode]} Keep meaning, numbers, names, dates, citations and terms. Invent nothing. Answer with JSON holding revised_text and change_summary.")
    if notes is not None:
        rules = F.when(F.size(notes) > 0, F.concat(rules, F.lit("\nThe last attempt was rejected for: "), F.array_join(notes, "; "))).otherwise(rules)
    wanted = F.coalesce(F.nullif(tx.strip(request), F.lit("")), F.lit("none given"))
    return F.concat_ws("\n\n", rules, F.concat(F.lit("PROFILE (data)\nBEGIN\n"), profile, F.lit("\nEND")), F.concat(F.lit("COMPARISON (data)\nBEGIN\n"), comparison, F.lit("\nEND")), F.concat(F.lit("REQUEST\n"), wanted), F.concat(F.lit("DRAFT (data)\nBEGIN\n"), draft, F.lit("\nEND")))


def revise_batch(drafts: DataFrame, provider: Callable[[str], str], max_attempts: int = 1, mode: str = "conservative", recompare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Revise every draft; a pass over the rows that still fail for each attempt, and the provider runs on the executors.

    drafts: key, draft, profile_text, comparison_text, user_request, and if known terms (array) and status_before.
    recompare turns (key, draft) of changed drafts into (key, status); then drift is known.  Each pass is written out,
    because a provider's answer can't be computed again.
    """
    if not 1 <= max_attempts <= MOST_ATTEMPTS:
        raise ValueError(f"max_attempts must be 1 to {MOST_ATTEMPTS}")

    @F.pandas_udf(T.StringType())
    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(provider)

    for name, kind in (("terms", "array<string>"), ("status_before", "string")):
        if name not in drafts.columns:
            drafts = drafts.withColumn(name, F.lit(None).cast(kind))
    state = drafts.withColumn("error", input_errors(F.col("draft"), F.col("user_request")))
    no_drift = F.struct(F.col("status_before").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(False).alias("drifted"))
    none = F.array().cast("array<string>")
    done = state.where("error is not null").select("key", F.lit("").alias("revised"), F.array(F.col("error")).alias("failures"), none.alias("warnings"), no_drift.alias("drift"), F.lit(False).alias("passed"), F.lit(0).alias("attempts"))
    todo = state.where("error is null").drop("error").withColumn("notes", none)
    columns = todo.columns
    for attempt in range(1, max_attempts + 1):
        asked = todo.withColumn("response", answer(prompt(F.col("draft"), F.col("profile_text"), F.col("comparison_text"), F.coalesce("user_request", F.lit("")), mode, F.col("notes"))))
        asked = materialise(asked.withColumn("revised", parse_response(F.col("response"))).drop("response"), "revised")
        if recompare is None:
            after = asked.withColumn("status_after", F.lit(None).cast("string"))
        else:  # an unchanged or empty text tells nothing new
            changed = asked.where((F.col("revised") != F.col("draft")) & (tx.strip(F.col("revised")) != "")).select("key", F.col("revised").alias("draft"))
            after = asked.join(recompare(changed).select("key", F.col("status").alias("status_after")), "key", "left")
        checked = materialise(validate_revision(after, "draft", "revised"), "checked")
        ended = checked if attempt == max_attempts else checked.where("passed")
        done = done.unionByName(ended.select("key", "revised", "failures", "warnings", "drift", "passed", F.lit(attempt).alias("attempts")))
        todo = checked.where("not passed").withColumn("notes", F.col("failures")).select(*columns)
    return done


def revise_drafts(drafts: DataFrame, samples: DataFrame, provider: Callable[[str], str], max_attempts: int = 1, mode: str = "conservative", profile_key: str = "author", sample: str = "sample_index") -> DataFrame:
    """Compare, revise, compare again: revise_batch() for drafts (key, profile_key, draft, user_request) and their authors' samples."""
    from inkspan.operators import compare as cp
    from inkspan.operators import profile as pf
    from inkspan.operators import report as rp

    theirs = materialise(pf.sample_table(samples.select(profile_key, sample, "text")), "samples")
    profiles = materialise(pf.profiles_of(theirs, profile_key, sample), "profiles")
    numbers = materialise(pf.profile_numbers(pf.long_features(theirs, [profile_key]), [profile_key]), "numbers")
    wanted = materialise(cp.wanted_phrases(theirs, profile_key, sample), "wanted")

    def rows_of(texts: DataFrame) -> DataFrame:
        mine = materialise(pf.sample_table(texts.select("key", profile_key, F.col("draft").alias("text"))), "drafts")
        return materialise(cp.rows_against(mine, numbers, wanted, ["key"], profile_key), "rows")

    def recompare(changed: DataFrame) -> DataFrame:
        rows = rows_of(changed.join(drafts.select("key", profile_key), "key"))
        return cp.overall_status(cp.dimension_status(rows, ["key"]), ["key"])

    rows = rows_of(drafts)
    dims = cp.dimension_status(rows, ["key"])
    words = {name: F.transform(F.filter(F.coalesce(name, F.array()), lambda x: x["sample_presence"] >= 1.0), lambda x: x["item"]) for name in ("common_terms", "common_connectives")}
    terms = F.slice(F.array_distinct(F.concat(words["common_terms"], words["common_connectives"])), 1, 20)
    about = profiles.select(profile_key, terms.alias("terms"), rp.profile_text(*(F.col(c) for c in ("numbers", "sample_count", "total_words", "context", "common_terms", "common_connectives"))).alias("profile_text"))
    before = cp.overall_status(dims, ["key"]).select("key", F.col("status").alias("status_before"))
    ready = drafts.join(about, profile_key).join(rp.comparison_text(rows, dims, ["key"]), "key", "left").join(before, "key", "left")
    ready = ready.select("key", "draft", "profile_text", F.coalesce("comparison_text", F.lit("")).alias("comparison_text"), "user_request", "terms", "status_before")
    return revise_batch(materialise(ready, "ready"), provider, max_attempts, mode, recompare)
