"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams, one of target texts and one of
the raw corpus, give each text its log importance weight: the log of the ratio
of its probabilities under the two, that is the sum of its n-grams' log ratios.
Texts are sampled without replacement in proportion to their importance
weights, by adding Gumbel noise to the logs and keeping the k largest sums.  So
of two texts whose weights differ by d, the one is drawn before the other with
odds of e^d: what differs much is sorted, and close cases are left to chance.

The raw model counts all n-grams of all documents.  The target model is of a
bounded sample of labelled rows of quality 1 (MOST_LABELLED of each label, those
whose hashed ids are least); half of the sample fits the model.  k is a
parameter; where none is given the other half, with rows of quality 0, sets it:
the number of documents whose weight is above the cut with the fewest errors,
where a good text lost counts GOOD_COST times.

The n-grams fall into BUCKETS, so few that the target's counts are steady; the
sum over a long text would add up the errors of rare buckets otherwise.

The noise is a function of a seed and a row's id and text, so it survives a lost
executor.

Edge cases: a null or empty text has no n-grams and weight 0; without labelled
rows of both kinds nothing is rejected; repeated rows share one key and are kept
or go together, and so do ties at the k-th place; null ids are fine; an empty
table gives no rows; filtering keeps all columns.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import forgetting, materialise, small_table, worker_cache

BITS = 11
BUCKETS = 1 << BITS
GOOD_COST = 3.0
MOST_LABELLED = 2000
SEED = 0

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    LIMIT = 150_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[token] = zlib.crc32(token.encode()) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return h


_HASHES = _Hashes()


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of a text's words and pairs of words; runs of marks are words too, and every doubled word is one pair."""
    worker_cache("quality", _HASHES.clear)
    tokens = _TOKEN.findall(text) if text else []
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0xBF58476D1CE4E5B9)) ^ (h[1:] + np.uint64(0x94D049BB133111EB))
    pairs *= np.uint64(0x9E3779B97F4A7C15)
    pairs[h[:-1] == h[1:]] = 0  # a word right after itself is one n-gram, whatever the word
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def count_ngrams(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row for each bucket, and tasks are added up."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                counts += np.bincount(ngrams(t.as_py()), minlength=BUCKETS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(forgetting(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    t, r = target + 0.5, raw + 0.5
    return (np.log(t / t.sum()) - np.log(r / r.sum())).astype(np.float32)


def weight_of(text: str | None, ratio: np.ndarray) -> float:
    """The log importance weight."""
    return float(ratio[ngrams(text)].sum(dtype=np.float64))


def noise(key, text: str | None, seed: int = SEED) -> float:
    """Gumbel noise that depends on nothing but the seed and the row."""
    u = ((xxhash.xxh64_intdigest(f"{key}\n{text}", seed) >> 11) + 0.5) / (1 << 53)
    return -math.log(-math.log(u))


def best_cut(weights: np.ndarray, good: np.ndarray, good_cost: float = GOOD_COST) -> float:
    """The weight below which rejecting makes the fewest errors, amid the gap."""
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], good[order]
    cost = np.concatenate([[0], np.cumsum(y * good_cost)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    usable = np.concatenate([[True], w[1:] > w[:-1], [True]])  # no cut between equal weights
    i = int(np.argmin(np.where(usable, cost, np.inf)))
    if i == 0:
        return -np.inf
    return float(w[i - 1] + (w[i] - w[i - 1]) / 2) if i < len(w) else np.inf


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[tuple[str, int, int]]:
    """At most `most` texts of each label that aren't held out: (text, quality, draw)."""
    spark = docs.sparkSession
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit("quality")))
    picked = [r for good in (1, 0) for r in known.where((F.col("quality") > 0) == F.lit(bool(good))).orderBy("draw", "doc_id").limit(most).collect()]  # at most 2 * most rows
    if not picked:
        return []
    sample = small_table(spark, {"doc_id": ("int64", [r["doc_id"] for r in picked]), "quality": ("int32", [int(r["quality"] > 0) for r in picked]), "draw": ("int64", [r["draw"] for r in picked])})
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality", "draw").agg(F.min("text").alias("text"))
    return [(r["text"], r["quality"], r["draw"]) for r in sorted(texts.collect(), key=lambda r: (r["draw"], r["doc_id"]))]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """(log ratio of each bucket, least weight of a good text); None without labelled rows of both kinds."""
    sample = labelled_sample(docs, labels)
    good, bad = [t for t, q, _ in sample if q], [t for t, q, _ in sample if not q]
    if len(good) < 2 or not bad:
        return None
    raw, target = count_ngrams(docs), np.zeros(BUCKETS)
    for t in good[::2]:
        target += np.bincount(ngrams(t), minlength=BUCKETS)
    ratio = log_ratio(target, raw)
    tried = good[1::2] + bad
    weights = np.array([weight_of(t, ratio) for t in tried])
    return ratio, best_cut(weights, np.array([1.0] * len(good[1::2]) + [0.0] * len(bad)))


def _weighed(docs: DataFrame, ratio: np.ndarray | None, keep: list[str], seed: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("log_weight", T.DoubleType()), T.StructField("sample_key", T.DoubleType())])
    at, key_at = keep.index("text"), keep.index("doc_id")

    def run(batches):
        import pyarrow as pa

        ratio = shared.value
        for b in batches:
            texts, keys = [t.as_py() for t in b.column(at)], b.column(key_at).to_pylist()
            w = np.array([0.0 if ratio is None else round(weight_of(t, ratio), 9) for t in texts])
            g = np.array([noise(k, t, seed) for k, t in zip(keys, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64()), pa.array(w + g, pa.float64())], names=[f.name for f in schema.fields])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(forgetting(run), schema)


def kth_largest(table: DataFrame, column: str, k: int, most: int = 5000) -> float:
    """The exact k-th largest value: histograms of ever narrower ranges, until few enough are left to look at."""
    lo, hi = table.agg(F.min(column), F.max(column)).first()
    above = 0  # values beyond the range
    while True:
        inside = table.where(F.col(column).between(lo, hi))
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            return lo
        slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        counts = {r["slot"]: r for r in inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}  # at most 1024 rows
        for s in sorted(counts, reverse=True):
            r = counts[s]
            if above + r["n"] >= k:
                break
            above += r["n"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi:
            return lo
        if r["n"] <= most:
            values = sorted((x[0] for x in table.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)  # at most `most` rows
            return values[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every document; k texts are kept, by default as many as weigh like good ones."""
    model = fit(docs, labels)
    table = materialise(_weighed(docs.select("doc_id", "text"), model[0] if model else None, ["doc_id", "text"], seed).drop("text"), "weights")
    return table.withColumn("kept", (F.col("sample_key") >= F.lit(_least_key(table, model, k))).cast("int"))


def _least_key(table: DataFrame, model, k: int | None) -> float:
    n = table.count()
    if k is None:
        k = table.where(F.col("log_weight") >= F.lit(float(model[1]))).count() if model and np.isfinite(model[1]) else n
    if k >= n:
        return float("-inf")
    return kth_largest(table, "sample_key", k) if k > 0 else float("inf")


def keep_sampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents, with all their columns, that resampling keeps; written once with their keys, so no text is weighed twice."""
    model = fit(docs, labels)
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}" if c not in ("doc_id", "text") else c) for i, c in enumerate(docs.columns)))
    table = materialise(_weighed(inner, model[0] if model else None, inner.columns, seed), "weights")
    kept = table.where(F.col("sample_key") >= F.lit(_least_key(table, model, k)))
    return kept.select(*(F.col(a).alias(c) for a, c in zip(inner.columns, docs.columns, strict=True)))
