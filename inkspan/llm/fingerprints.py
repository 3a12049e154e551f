"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words' shingles of WIDTH words (all words as
one term where there are fewer), each weighted by how often it occurs.  For
sample k a term of weight w has r and c from Gamma(2, 1) and b from U(0, 1):

    t = floor(ln w / r + b)        a = ln c - r (t - b) - r

and the term with the least a, together with its t, is the sample.  Two texts
agree in a sample with a probability of their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones.

The draws come from a pool of POOL rows with a triple for each k; a term's hash
picks its row, so nothing is drawn per term.  Terms with one row are ordered by
hash, which keeps the samples consistent.  A sample is stored in 16 bits.

Edge cases: a null or empty text, or one of white space, has no terms and the
fingerprint of zeros, which is like itself (1) and unlike any other (0).  Null
doc_ids come first in the order; rows that share a doc_id are ordered by their
texts' hash; a table of one row is its own next document; an empty table gives
no rows; only doc_id and text are read, so other columns can have any names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import bucket_count, forgetting, id_boundaries, worker_cache

SAMPLES = 64
WIDTH = 2
POOL = 1 << 16
#: Terms whose samples are drawn at once; bounds a long text's memory.
AT_ONCE = 4096

_ODD = 0x9E3779B97F4A7C15


class Words(dict):
    """Word -> 64-bit hash, remembered up to a limit."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = Words()


def _forget() -> None:
    _WORDS.clear()
    _draws.cache_clear()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words, in order; of all words as one run where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    worker_cache("words", _forget)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, len(h) if len(h) < width else width, np.uint64)
        for k in range(min(width, len(h))):
            total = (total ^ h[k : k + n]) * np.uint64(_ODD)
            total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


@lru_cache(maxsize=2)
def _draws(samples: int, pool: int):
    rng = np.random.default_rng(20110)
    shape = (pool, samples)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    b = rng.random(shape, dtype=np.float32)
    return r, c, b, c + r * b - r  # the last is a for weight 1, where t is 0


def sample(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES, pool: int = POOL) -> np.ndarray:
    """The samples (16 bits each) of distinct, ascending term hashes with weights; zeros where there are none."""
    out = np.zeros(samples, np.uint16)
    if not len(terms):
        return out
    r, c, b, once = _draws(samples, pool)
    shift = np.uint64(64 - (pool.bit_length() - 1))
    columns = np.arange(samples)
    best, who, level = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.zeros(samples, np.int64)
    for at in range(0, len(terms), AT_ONCE):
        h, w = terms[at : at + AT_ONCE], weights[at : at + AT_ONCE]
        pick = (h >> shift).astype(np.int64)
        a = once[pick]
        many = np.flatnonzero(w != 1)
        t = None
        if len(many):
            rr, bb = r[pick[many]], b[pick[many]]
            t = np.floor(np.log(w[many]).astype(np.float32)[:, None] / rr + bb)
            a[many] = c[pick[many]] - rr * (t - bb) - rr
        i = a.argmin(axis=0)
        least = a[i, columns]
        better = least < best
        best[better], who[better] = least[better], h[i[better]]
        level[better] = 0
        if t is not None:
            row = np.full(len(h), -1)
            row[many] = np.arange(len(many))
            own = row[i]
            use = better & (own >= 0)
            level[use] = t[own[use], columns[use]].astype(np.int64)
    with np.errstate(over="ignore"):
        mixed = (who + level.astype(np.uint64) * np.uint64(0x94D049BB133111EB)) * np.uint64(_ODD)
    out[:] = mixed >> np.uint64(48)
    out[out == 0] = 1
    return out


def fingerprint(text: str | None, samples: int = SAMPLES, width: int = WIDTH) -> np.ndarray:
    terms, weights = np.unique(shingle_hashes((text or "").lower().encode().split(), width), return_counts=True)
    return sample(terms, weights, samples)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples."""
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of doc_id, in order, each range ending with a copy of the next one's first row.

    Only the ranges' bounds, quantiles of doc_id, go to the driver.  The text is shuffled once.
    """
    cuts = id_boundaries(docs, bucket_count(docs))
    facts = docs.agg(F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    cuts = np.array([c for c in cuts if c != facts["least"] or facts["nulls"]], dtype=np.int64)
    first = None if facts["nulls"] else facts["least"]
    last = len(cuts)

    def deal(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            key = b.column(0).cast(pa.int64())
            filled = pc.fill_null(key, -(1 << 63)).to_numpy(zero_copy_only=False)
            range_of = np.searchsorted(cuts, filled, side="right")
            null = pc.is_null(key).to_numpy(zero_copy_only=False)
            is_first = null if first is None else (filled == first) & ~null
            starts = np.zeros(len(filled), bool)
            if last:
                starts = (range_of > 0) & (filled == cuts[np.maximum(range_of, 1) - 1]) & ~null
            again = np.flatnonzero(starts | is_first)
            take = np.concatenate([np.arange(len(filled)), again])
            to = np.concatenate([range_of, np.where(is_first[again], last, range_of[again] - 1)])
            tail = np.concatenate([np.zeros(len(filled), bool), np.ones(len(again), bool)])
            rows = pa.RecordBatch.from_arrays([key, b.column(1), b.column(2)], names=["doc_id", "text", "tie"]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(tail), *rows.columns], names=["range", "tail", "doc_id", "text", "tie"])

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).mapInArrow(deal, "range int, tail boolean, doc_id long, text string, tie long")
    return dealt.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "tie")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to each other and to the next document's."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()), strict=True)])

    def run(batches):
        import pyarrow as pa

        rows: list[tuple] = []
        before = None  # (range, doc_id, text, fingerprint), waiting for its next document

        def flush():
            done = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]))
            rows.clear()
            return done

        for b in batches:
            for place, tail, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py()
                if tail and before is None:
                    continue  # a second copy of a shared doc_id
                own = fingerprint(text, samples, width)
                if before is not None:
                    _, old_key, old_text, old = before
                    new_text = edited(old_text, text)
                    new = fingerprint(new_text, samples, width)
                    rows.append((old_key, len(old_text), hashlib.sha256(new_text.encode()).hexdigest(), old.astype(">u2").tobytes().hex(), new.astype(">u2").tobytes().hex(), likeness(old, new), likeness(old, own)))
                before = None if tail else (place, key, text, own)
                if len(rows) >= 512:
                    yield flush()
        if rows:
            yield flush()

    return with_next(docs).select("range", "tail", "doc_id", "text").mapInArrow(forgetting(run), schema)
