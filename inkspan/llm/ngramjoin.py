"""Similarity join of texts on word shingles, exact, with components.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least PERCENT / 100.  The join is exact; no step caps partners or candidates.

1. One scan makes each text's set of 64-bit shingle hashes and deals the hashes
   out, packed, into buckets of hashes (a copy of a text in the same batch is
   dealt once, and a hash that more than HOT texts of a batch hold is dealt once
   with its count).  A bucket's task sees all holders of a hash, and answers each
   batch with the shared hashes of its texts and how frequent they are.  A bucket
   knows a hash by its 40 low bits, so of n hashes two different ones are taken
   for one with a chance of n^2 / 2^41 / buckets.  From there on a hash is its rank
   among the shared hashes of its bucket, and the bucket's number: some four bytes.
2. A link needs an overlap of PERCENT / 100 of either set.  So texts with too
   many hashes of their own drop out, and the others are candidates by their
   prefix: their rarest shared hashes, of which linked texts have one in common.
3. Rounds of star links: each text is compared with a leader among the holders
   of its prefix hashes; texts that link are one component from then on.  A
   group of n near copies costs about n comparisons, not n * n.
4. What is left are hashes whose holders are in several components.  Their
   holders are banded by set size and dealt into tiles; each holder outside the
   largest component meets all tiles whose band allows a link.  Hashed bitmap
   signatures bound the overlap from above by their bit counts, and the pairs
   that pass are confirmed by intersecting the sorted arrays.  Rounds that take
   each text's most promising partner in another component go on while they join
   much, at one pair a text; a last one takes every pair still left.

For components() pairs inside a component need no comparison; every pair across
components that could link is compared.  similar_pairs() returns all pairs of
different sets that link, so there no component is passed over.

Edge cases: a null or empty text, or one of white space, has an empty set and is
its own component; a text with fewer words than a shingle is one shingle of all
its words; rows with a null doc_id take part, and a component of only such rows
has the id null; repeated rows each give a row; an empty table gives no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import collect_garbage, forgetting, input_bytes, materialise, partition_id, release, shuffle_partitions
from inkspan.llm.fingerprints import shingle_hashes

WIDTH, PERCENT = 5, 80
#: Hashes that a batch of texts deals out; bounds a task's memory.
BATCH_HASHES = 1_500_000
#: A signature has at least so many bits for each hash, and LEAST_BITS; a power of two, so the longer of two folds onto the shorter.
BITS_EACH, LEAST_BITS = 2, 256
#: A hash that more texts of a batch hold is dealt as one count.
HOT = 32
#: Texts in a tile, at least; tiles of a hash with many holders grow with the square root of their number.
TILE = 256
#: Star rounds go on while one in MOST_STARS of their pairs links, up to here.
STAR_ROUNDS, MOST_STARS = 2, 2
#: Words of the bitmap that tells which sets' arrays a round needs; at most 4 MB are broadcast.
BITMAP_WORDS = 1 << 18
#: Tile rounds that take only each text's most promising partner in another component; they end when fewer than one in LEAST_FOUND of their pairs links, or here, and the next one takes all that is left.
BEST_ROUNDS, LEAST_FOUND = 8, 4
#: Buckets at most; up to 1 TB of text a bucket has 4 MB of it, beyond that buckets grow.
MOST_BUCKETS = 1 << 18
#: Hashes of a set are dealt as 40 bits.
LOW = (1 << 40) - 1


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(words_of(text), width))


def links(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return a > 0 and b > 0 and 100 * both >= percent * (a + b - both)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


def _low5(h: np.ndarray) -> bytes:
    return (h & np.uint64(LOW)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _packed(tokens: np.ndarray, width: int) -> bytes:
    """Numbers in so many bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _width(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 7) // 8)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros((n, 8), np.uint8)
    own = np.frombuffer(data, np.uint8).reshape(n, -1)
    out[:, : own.shape[1]] = own
    return out.view("<u8").ravel()


def signature(tokens: np.ndarray) -> bytes:
    bits = 1 << max(LEAST_BITS, BITS_EACH * len(tokens) - 1).bit_length() if BITS_EACH * len(tokens) > LEAST_BITS else LEAST_BITS
    out = np.zeros(bits, np.uint8)
    out[((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A signature of 64-bit words folded onto `size` words."""
    while len(words) > size:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


def _gaps(owners: np.ndarray) -> bytes:
    """Ascending numbers as steps in Rice's code: about a bit more than the logarithm of the mean step.

    A byte with the number k of plain bits and the length of the count, the count, all plain bits, all unary parts.
    """
    n = len(owners)
    if not n:
        return b""
    steps = np.diff(owners, prepend=0).astype(np.int64)
    k = max(0, (int(owners[-1]) // n).bit_length() - 1)
    width = _width(n)
    ends = np.cumsum((steps >> k) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    plain = ((steps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return bytes([k | (width - 1) << 6]) + n.to_bytes(width, "little") + np.packbits(plain).tobytes() + np.packbits(unary).tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    k, width = data[0] & 63, (data[0] >> 6) + 1
    n, at = int.from_bytes(data[1 : 1 + width], "little"), 1 + width
    body = np.frombuffer(data, np.uint8)
    after = at + (n * k + 7) // 8
    steps = np.diff(np.flatnonzero(np.unpackbits(body[after:])), prepend=-1) - 1
    if k:
        plain = np.unpackbits(body[at:after], count=n * k).reshape(n, k)
        steps = (steps << k) + plain @ (1 << np.arange(k))
    return np.cumsum(steps, dtype=np.int64)


def _counts(values) -> bytes:
    return np.asarray(values, "<u4").tobytes()


def _deal(buckets: int, width: int, batch_hashes: int = BATCH_HASHES, hot: int = HOT):
    """Stage 1: texts -> packed hashes by bucket, and each batch's own list of texts."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("target", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("texts", pa.binary()), ("hashes", pa.binary()), ("hot", pa.binary()), ("hot_counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64()))])
        task, number = partition_id(), 0
        sets, sizes, ids, keys, ties, places, held, seen = [], [], [], [], [], [], 0, {}

        def flush():
            nonlocal number
            batch = (task << 24) | number
            number += 1
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            often, times = np.unique(flat, return_counts=True)
            often, times = often[times > hot], times[times > hot]
            hot_owner = np.zeros(0, np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                is_hot = often[at] == flat
                hot_owner = owner[is_hot][np.argsort(at[is_hot], kind="stable")]  # the holders of each hot hash, one hash after the other
                flat, owner = flat[~is_hot], owner[~is_hot]
            # the batch's own row holds its texts and the holders of its hot hashes
            rows = [{"target": int(xxhash.xxh32_intdigest(str(batch)) % buckets), "batch": batch, "kind": 0, "texts": _counts(sizes) + _counts(places), "hashes": _counts(hot_owner), "hot": often.astype("<u8").tobytes(), "hot_counts": _counts(times), "ids": list(ids), "keys": list(keys), "ties": list(ties)}]
            to = ((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            flat, owner, to = flat[order], owner[order], to[order]
            hot_to = ((often >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            for k in np.union1d(to, hot_to).tolist():
                i, j = np.searchsorted(to, k, "left"), np.searchsorted(to, k, "right")
                x, y = np.searchsorted(hot_to, k, "left"), np.searchsorted(hot_to, k, "right")
                rows.append({"target": k, "batch": batch, "kind": 1, "texts": _gaps(owner[i:j]), "hashes": _low5(flat[i:j]), "hot": _low5(often[x:y]), "hot_counts": _counts(times[x:y]), "ids": None, "keys": None, "ties": None})
            for x in (sets, sizes, ids, keys, ties, places):
                x.clear()
            seen.clear()
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema=schema)

        for b in batches:
            for key, text, tie in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                s = shingle_set(text.as_py(), width)
                digest = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0
                ids.append(key)
                keys.append(digest)
                ties.append(tie)
                sizes.append(len(s))
                if not len(s):
                    places.append(0xFFFFFFFF)
                elif digest in seen:
                    places.append(0xFFFFFFFF)
                else:
                    seen[digest] = True
                    places.append(len(sets))
                    sets.append(s)
                    held += len(s)
                if held >= batch_hashes or len(ids) >= 50_000:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return run


def _classes(frequency: np.ndarray) -> np.ndarray:
    """Eighths of a power of two."""
    return np.minimum(255, np.log2(frequency) * 8).astype(np.uint8)


def _answer(batches):
    """Stage 2: for each bucket, which of a batch's hashes are shared with another text, as ranks, and how frequent they are."""
    import pyarrow as pa

    schema = pa.schema([("batch", pa.int64()), ("target", pa.int32()), ("texts", pa.binary()), ("hashes", pa.binary()), ("classes", pa.binary()), ("hot", pa.binary()), ("hot_counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64()))])
    none = {"hashes": None, "classes": None, "hot": None, "hot_counts": None, "ids": None, "keys": None, "ties": None}
    target, own = None, []

    def flush():
        values = np.concatenate([_from5(x) for r in own for x in (r["hashes"], r["hot"])])
        weights = np.concatenate([x for r in own for x in (np.ones(len(r["hashes"]) // 5, np.int64), np.frombuffer(r["hot_counts"], "<u4"))])
        order = np.argsort(values, kind="stable")
        v = values[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        times = np.diff(np.append(first, len(v)))
        holders = np.add.reduceat(weights[order], first)
        frequency, rank = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        frequency[order] = np.repeat(holders, times)
        rank[order] = np.repeat(np.cumsum(holders > 1) - 1, times)  # the same whatever order the rows come in
        width = _width(max(0, rank.max()))
        at = 0
        for r in own:
            n, hot = len(r["hashes"]) // 5, len(r["hot"]) // 5
            f, x, h, y = frequency[at : at + n], rank[at : at + n], frequency[at + n : at + n + hot], rank[at + n : at + n + hot]
            at += n + hot
            keep = f > 1
            if keep.any() or hot:
                yield pa.RecordBatch.from_pylist([none | {"batch": r["batch"], "target": target, "texts": _gaps(_from_gaps(r["texts"])[keep]), "hashes": _packed(x[keep], width), "classes": _classes(f[keep]).tobytes(), "hot": _classes(h).tobytes(), "hot_counts": _packed(y, width)}], schema=schema)

    for b in batches:
        for row in b.to_pylist():
            if row["kind"] == 0:
                yield pa.RecordBatch.from_pylist([none | {"batch": row["batch"], "target": -1, **{k: row[k] for k in ("texts", "hashes", "hot", "hot_counts", "ids", "keys", "ties")}}], schema=schema)
                continue
            if own and row["target"] != target:
                yield from flush()
                own = []
            target = row["target"]
            own.append(row)
    if own:
        yield from flush()


def inner_overlap(n: int, percent: int = PERCENT) -> int:
    """Least overlap of a set of n with a set that is at least as large."""
    return -(-2 * percent * n // (100 + percent))


def _gather(buckets: int, percent: int):
    """Stage 3: each batch's answers -> a row for every text, and one for every candidate."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("shared", pa.int32()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64())), ("inner", pa.int32()), ("signature", pa.binary()), ("batch", pa.int64())])
        batch, own = None, []

        def flush():
            head = next(r for r in own if r["target"] == -1)
            n = len(head["ids"])
            sizes, places = np.frombuffer(head["texts"], "<u4").reshape(2, n)
            yield pa.RecordBatch.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(head["ties"], pa.int64()), pa.array([k if s else None for k, s in zip(head["keys"], sizes.tolist(), strict=True)], pa.int64()), pa.array(sizes.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=schema)
            answers = [r for r in own if r["target"] >= 0]
            if not answers:
                return

            def named(ranks: bytes, n: int, target: int):
                return _unpacked(ranks, n) * np.uint64(buckets) + np.uint64(target)

            owner = [_from_gaps(r["texts"]) for r in answers]
            tokens = [named(r["hashes"], len(o), r["target"]) for r, o in zip(answers, owner, strict=True)]
            classes = [np.frombuffer(r["classes"], np.uint8) for r in answers]
            if head["hot"]:  # they ascend, and so do the buckets they were dealt to
                times = np.frombuffer(head["hot_counts"], "<u4")
                ascending = sorted(answers, key=lambda r: r["target"])
                tokens.append(np.repeat(np.concatenate([named(r["hot_counts"], len(r["hot"]), r["target"]) for r in ascending]), times))
                classes.append(np.repeat(np.concatenate([np.frombuffer(r["hot"], np.uint8) for r in ascending]), times))
                owner.append(np.frombuffer(head["hashes"], "<u4").astype(np.int64))
            tokens, classes, owner = np.concatenate(tokens), np.concatenate(classes), np.concatenate(owner)
            order = np.lexsort((tokens, classes, owner))
            tokens, owner = tokens[order], owner[order]
            ends = np.searchsorted(owner, np.arange(int((places != 0xFFFFFFFF).sum()) + 1))
            rows = []
            for i, place in enumerate(places.tolist()):
                if place == 0xFFFFFFFF:
                    continue
                t = tokens[ends[place] : ends[place + 1]]
                size, need = int(sizes[i]), least_overlap(int(sizes[i]), percent)
                if len(t) < need:
                    continue
                prefix = t[: len(t) - need + 1]
                rows.append({"doc_id": None, "tie": None, "key": head["keys"][i], "size": size, "shared": len(t), "tokens": _packed(np.sort(t), _width(t.max())), "prefix": prefix.astype(np.int64).tolist(), "inner": max(0, len(t) - inner_overlap(size, percent) + 1), "signature": signature(t), "batch": batch})
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for b in batches:
            for row in b.to_pylist():
                if own and row["batch"] != batch:
                    yield from flush()
                    own = []
                batch = row["batch"]
                own.append(row)
        if own:
            yield from flush()

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b))


def _confirm(percent: int):
    """Rows sorted by group, its leader first -> pairs that link."""

    def run(batches):
        import pyarrow as pa

        leader = None
        for b in batches:
            found: list[tuple[int, int]] = []
            for group, first, key, size, shared, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                if first == 0:
                    if leader is None or leader[0] != group or leader[1] != key:
                        leader = (group, key, size, _unpacked(tokens.as_py(), shared))
                elif leader is not None and leader[0] == group and key != leader[1]:
                    if links(size, leader[2], _overlap(_unpacked(tokens.as_py(), shared), leader[3]), percent):
                        found.append((key, leader[1]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def allows(size: int, shared: int, bits: bytes, other_size: int, other_shared: int, other_bits: bytes, percent: int) -> bool:
    """Whether two signatures allow a link."""
    mine, theirs = np.frombuffer(bits, "<u8"), np.frombuffer(other_bits, "<u8")
    n = min(len(mine), len(theirs))
    mine, theirs = folded(mine, n), folded(theirs, n)
    both = min(shared - int(np.bitwise_count(mine & ~theirs).sum()), other_shared - int(np.bitwise_count(theirs & ~mine).sum()))
    return links(size, other_size, both, percent)


def _by_signature(percent: int):
    """Rows (a, size, shared, signature, b, its size, shared, signature) -> pairs that the signatures allow."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(8)]
            keep = pa.array([allows(*r[1:4], *r[5:8], percent) for r in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4)], names=["a", "b"]).filter(keep)

    return run


def promising(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link; no array is moved for the others."""
    one = details_of(candidates)
    left, right = (one.select(F.col("key").alias(k), F.col("size").alias(f"size_{k}"), F.col("shared").alias(f"shared_{k}"), F.col("signature").alias(f"signature_{k}")) for k in "ab")
    met = pairs.join(left, "a").join(right, "b").select("a", "size_a", "shared_a", "signature_a", "b", "size_b", "shared_b", "signature_b")
    return met.mapInArrow(forgetting(_by_signature(percent)), "a long, b long")


def details_of(candidates: DataFrame) -> DataFrame:
    return candidates.select("key", "size", "shared", "signature").dropDuplicates(["key"])


def _bitmap(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(word, bits) of a bitmap of fixed size in which the rows are marked by the hash of some columns."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(64 * BITMAP_WORDS))
    bit = F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))")
    return rows.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _marked(table: DataFrame, bitmap: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that the bitmap has, and few others, as a bit may stand for several; nothing but the bitmap is broadcast."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(64 * BITMAP_WORDS))
    met = table.withColumn("slot", slot).withColumn("word", F.floor(F.col("slot") / 64)).join(F.broadcast(bitmap), "word")
    return met.where(F.expr("getbit(bits, cast(pmod(slot, 64) as int)) = 1")).drop("slot", "word", "bits")


def _needed(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates that the pairs name, and few others."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    return _marked(candidates, _bitmap(keys, ["key"]), ["key"])


def confirm(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of keys that link, by intersecting their sorted arrays; b's array is read once for some 200 a."""
    salted = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    sized = pairs.join(salted, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / 200)).cast("int"))
    one = _needed(candidates.select("key", "size", "shared", "tokens"), pairs)
    members = sized.select("b", "salt", F.col("a").alias("key"), F.lit(1).alias("place"))
    leaders = sized.select("b", "salt").distinct().select("b", "salt", F.col("b").alias("key"), F.lit(0).alias("place"))
    rows = members.unionByName(leaders).join(one, "key").withColumn("group", F.xxhash64("b", "salt"))
    ordered = rows.select("group", "place", "key", "size", "shared", "tokens").repartition("group").sortWithinPartitions("group", "place")
    return ordered.mapInArrow(forgetting(_confirm(percent)), "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): the least node that a path reaches."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("best"))
        better = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "best").alias("best"))
        hop = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        new = materialise(better.join(hop, "best").select("node", F.least("best", "far").alias("label"), (F.least("best", "far") < F.col("label")).alias("moved")), "labels")
        release(held)
        held, labels = new, new.select("node", "label")
        if new.where("moved").isEmpty():
            release(both)
            return labels


def _merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Components after the edges, which are between keys; None while there are none."""
    if edges.isEmpty():
        return labels
    if labels is None:
        return connected(edges)
    up = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    down = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    lifted = edges.join(up, "a", "left").join(down, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    if lifted.isEmpty():
        return labels
    merged = connected(lifted)
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = merged.join(labels, "node", "left_anti").select("node", "label")
    return materialise(moved.unionByName(fresh), "labels")


def _with_label(holders: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return holders.withColumn("label", F.col("key"))
    return holders.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _allowed(own: list, key: int, size: int, shared: int, label: int, bits: bytes, percent: int):
    """(keys, labels, overlap bounds) of the tile's texts across components whose signatures allow a link."""
    mine = np.frombuffer(bits, "<u8")
    found = []
    for words, (keys, sizes, counts, labels, bitmaps) in own:
        here = np.flatnonzero((labels != label) & (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)))
        if not len(here):
            continue
        theirs = bitmaps[here]
        while theirs.shape[1] > len(mine):
            theirs = theirs[:, : theirs.shape[1] // 2] | theirs[:, theirs.shape[1] // 2 :]
        probe = folded(mine, theirs.shape[1])
        # a bit that only one of two sets has stands for at least one hash the other lacks
        both = np.minimum(shared - np.bitwise_count(probe & ~theirs).sum(axis=1, dtype=np.int64), counts[here] - np.bitwise_count(theirs & ~probe).sum(axis=1, dtype=np.int64))
        fits = 100 * both >= percent * (size + sizes[here] - both)
        here = here[fits]
        found += zip(keys[here].tolist(), labels[here].tolist(), (both[fits] / (size + sizes[here] - both[fits])).tolist(), strict=True)
    return found


def _tiles(percent: int, best_only: bool):
    """Rows sorted by tile, its texts first -> pairs across components that the signatures allow.

    best_only: for each probe only the one with the highest bound.
    """

    def run(batches):
        import pyarrow as pa

        tile, own, block = None, [], None
        for b in batches:
            found: dict[tuple[int, int], float] = {}
            for at, probe, key, size, shared, label, bits in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if at != tile:
                    tile, own, block = at, [], None
                if not probe:
                    own.append((key, size, shared, label, bits))
                    continue
                if block is None:
                    block = []
                    for words in sorted({len(x[4]) for x in own}):
                        same = [x for x in own if len(x[4]) == words]
                        block.append((words, [np.array([x[i] for x in same]) for i in range(4)] + [np.frombuffer(b"".join(x[4] for x in same), "<u8").reshape(len(same), -1)]))
                allowed = _allowed(block, key, size, shared, label, bits, percent)
                if best_only and allowed:
                    k, _, bound = max(allowed, key=lambda x: (x[2], x[0]))
                    found[key, k] = bound
                else:
                    found.update(((key, k), bound) for k, _, bound in allowed)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(list(found.values()), pa.float64())], names=["probe", "partner", "bound"])

    return run


def _sets(docs: DataFrame, width: int, percent: int, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row for every text, a row for every set that may link)."""
    size = input_bytes(docs)
    if buckets is None:
        buckets = max(2 * shuffle_partitions(docs.sparkSession), min(0 if size >= 1 << 60 else size // (4 << 20), MOST_BUCKETS))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).mapInArrow(forgetting(_deal(buckets, width)), "target int, batch long, kind int, texts binary, hashes binary, hot binary, hot_counts binary, ids array<long>, keys array<long>, ties array<long>")
    answered = dealt.repartition("target").sortWithinPartitions("kind", "target").mapInArrow(forgetting(_answer), "batch long, target int, texts binary, hashes binary, classes binary, hot binary, hot_counts binary, ids array<long>, keys array<long>, ties array<long>")
    gathered = answered.repartition("batch").sortWithinPartitions("batch", "target").mapInArrow(forgetting(_gather(buckets, percent)), "doc_id long, tie long, key long, size int, shared int, tokens binary, prefix array<long>, inner int, signature binary, batch long")
    table = materialise(gathered, "shingles")
    candidates = table.where("tokens is not null").drop("doc_id", "tie")
    # copies in several batches are one set: its first batch's row stands for all
    first = materialise(_bitmap(candidates.groupBy("key").agg(F.min("batch").alias("batch")), ["key", "batch"]), "first")
    return table.where("tokens is null").select("doc_id", "tie", "key", "size"), _marked(candidates, first, ["key", "batch"]).drop("batch")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the component's least doc_id) of every row."""
    texts, candidates = _sets(docs, width, percent, buckets)
    return _named(texts, link_components(candidates, percent))


def _named(texts: DataFrame, labels: DataFrame | None) -> DataFrame:
    per_key = texts.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    if labels is None:
        named = per_key.select("key", F.col("least").alias("component_id"))
    else:
        whole = materialise(_with_label(per_key, labels), "components")
        least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
        named = whole.join(least, "label").select("key", "component_id")
    full = texts.where("key is not null").join(named, "key").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id")
    empty = texts.where("key is null").select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def similar_pairs(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(every pair a, b of keys of different sets that link, doc_id and key of every row).

    Texts with one set share a key, and are pairs of each other without a row; a text without words has the key null.
    The pairs of a group of different near copies are as many as they are: this is the join's whole result.
    """
    texts, candidates = _sets(docs, width, percent, buckets)
    one = candidates.dropDuplicates(["key"])
    pairs = _across(_holders(one), one, None, percent, False)
    empty = docs.sparkSession.createDataFrame([], "a long, b long")
    return empty if pairs is None else confirm(pairs, one, percent), texts.select("doc_id", "key")


def _holders(candidates: DataFrame) -> DataFrame:
    """(token, key, size, whether the token is in the set's inner prefix) of all prefixes."""
    return candidates.select(F.posexplode("prefix").alias("at", "token"), "key", "size", "inner").select("token", "key", "size", (F.col("at") < F.col("inner")).alias("inner"))


def link_components(candidates: DataFrame, percent: int = PERCENT, before_round: Callable[[], None] = lambda: None) -> DataFrame | None:
    """(node, label) of all keys with a link to another; None without any link."""
    holders = _holders(candidates)
    labels: DataFrame | None = None
    for turn in range(STAR_ROUNDS):
        before_round()
        known = _with_label(holders, labels)
        if labels is None:  # keys are hashes, so the least one is as good as drawn
            chief = known.groupBy("token").agg(F.min(F.struct("key", "size")).alias("c"), F.max("key").alias("most")).where("c.key <> most").select("token", F.col("c.key").alias("chief"), F.col("c.size").alias("chief_size"), F.col("c.key").alias("chief_label"))
        else:
            draw = F.struct(F.xxhash64("key", F.lit(turn)).alias("draw"), F.col("key").alias("chief"), F.col("size").alias("chief_size"), F.col("label").alias("chief_label"))
            chief = known.groupBy("token").agg(F.min(draw).alias("c"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("token", "c.chief", "c.chief_size", "c.chief_label")
        chief = materialise(chief, "chiefs")  # so that the join has plain exchanges on both sides, and a hot token's holders are split
        met = materialise(known.join(chief, "token"), "holders")
        release(chief)
        before, holders = holders, met.select("token", "key", "size", "inner")  # of hashes that several components hold
        fits = met.where((F.col("label") != F.col("chief_label")) & (100 * F.least("size", "chief_size") >= percent * F.greatest("size", "chief_size")))
        best = fits.groupBy("key", "chief").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "chief")).alias("m"))
        pairs = materialise(promising(best.select(F.col("key").alias("a"), F.col("m.chief").alias("b")), candidates, percent), "pairs")
        release(before)
        n = pairs.count()
        if not n:
            break
        found = materialise(confirm(pairs, candidates, percent), "links")
        release(pairs)
        links_found = found.count()
        labels = _merge(labels, found)
        if MOST_STARS * links_found < n:
            break
    holders = holders.groupBy("token", "key", "size").agg(F.max("inner").alias("inner"))
    tried: DataFrame | None = None
    last = False
    for turn in range(BEST_ROUNDS + 1):
        before_round()
        last = last or turn == BEST_ROUNDS
        pairs = _across(holders, candidates, labels, percent, not last)
        if pairs is None:
            break
        n = pairs.count()
        if not n:
            break  # then no pair at all is left, as every text with one has a best one
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = materialise(confirm(fresh, candidates, percent), "links")
        links_found = found.count()
        labels = _merge(labels, found)
        release(found)
        if last:
            break
        last = LEAST_FOUND * links_found < n
        tried = pairs if tried is None else tried.unionByName(pairs)
    return labels


def _across(holders: DataFrame, candidates: DataFrame, labels: DataFrame | None, percent: int, best_only: bool) -> DataFrame | None:
    """Pairs of texts of different components that share a prefix hash and whose signatures allow a link; None if no hash has such holders.

    Sizes that can link are in one band or two neighbouring ones (a band spans a factor of 100 / percent), so a hash's
    holders are taken in windows: number 2 b is band b, number 2 b + 1 the bands b and b + 1.  A window lives if it
    has several components and a holder with the hash in its inner prefix.  Within a window the texts of the component
    with most holders needn't probe, as those of the others meet them.
    """
    band = F.floor(F.log("size") / F.lit(math.log(100 / percent) * 1.0000001)).cast("int")
    known = _with_label(holders, labels).withColumn("band", band)
    per_label = known.groupBy("token", "band", "label").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
    seen = per_label.withColumn("window", F.explode(F.array(2 * F.col("band") - 1, 2 * F.col("band"), 2 * F.col("band") + 1)))
    low = F.col("band") == F.floor(F.col("window") / 2)
    live = seen.groupBy("token", "window").agg(
        F.coalesce(F.sum(F.when(low, F.col("n"))), F.lit(0)).alias("low"), F.coalesce(F.sum(F.when(~low, F.col("n"))), F.lit(0)).alias("high"),
        F.max(F.struct("n", "label")).alias("top"), F.min("label").alias("least"), F.max("label").alias("most"), F.max("inner").alias("inner"),
    )
    live = materialise(live.where("inner and least <> most").select("token", "window", "low", "high", F.col("top.label").alias("main")), "windows")
    sides = F.array(F.struct(F.floor(F.col("window") / 2).cast("int").alias("band"), F.col("low").alias("n")), F.struct(F.floor(F.col("window") / 2 + 1).cast("int").alias("band"), F.col("high").alias("n")))
    bands = live.select("token", F.explode(sides).alias("s")).where("s.n > 0").groupBy("token", F.col("s.band").alias("band")).agg(F.max("s.n").alias("held"))
    bands = materialise(bands, "bands")  # so that the join has plain exchanges on both sides, and a hot token's holders are split
    rest = materialise(known.select("token", "key", "size", "label", "band").join(bands, ["token", "band"]), "live")
    if rest.isEmpty():
        for x in (live, bands, rest):
            release(x)
        return None

    def tiles(held):
        return F.ceil(held / F.greatest(F.lit(TILE), 16 * F.sqrt(held))).cast("int")

    # the holders of a band against those that probe there: blocks of a grid with as many rows as columns
    details = details_of(candidates).drop("size").join(rest.select("key").distinct(), "key")
    tile = F.xxhash64("token", "at_band", "at_tile", "part").alias("tile")
    bases = rest.withColumn("at_band", F.col("band")).withColumn("at_tile", F.pmod(F.xxhash64("key"), tiles(F.col("held"))).cast("int"))
    bases = bases.withColumn("part", F.explode(F.sequence(F.lit(0), tiles(F.col("held")) - 1))).select(tile, F.lit(0).alias("probe"), "key", "size", "label")
    ways = F.array(*(F.struct((2 * F.col("band") + d).alias("window"), (F.col("band") + d).alias("at_band")) for d in (-1, 0, 1)))
    ways = rest.select("token", "key", "size", "label", F.explode(ways).alias("w")).select("token", "key", "size", "label", "w.window", "w.at_band")
    at_held = F.when(F.col("at_band") == F.floor(F.col("window") / 2), F.col("low")).otherwise(F.col("high"))
    probes = ways.join(live, ["token", "window"]).where("label <> main").withColumn("at_held", at_held).where("at_held > 0")
    probes = probes.withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), tiles(F.col("at_held"))).cast("int")).withColumn("at_tile", F.explode(F.sequence(F.lit(0), tiles(F.col("at_held")) - 1))).select(tile, F.lit(1).alias("probe"), "key", "size", "label")
    rows = bases.unionByName(probes).join(details, "key").select("tile", "probe", "key", "size", "shared", "label", "signature")
    met = rows.repartition("tile").sortWithinPartitions("tile", "probe").mapInArrow(forgetting(_tiles(percent, best_only)), "probe long, partner long, bound double")
    if best_only:
        met = met.groupBy("probe").agg(F.max(F.struct("bound", "partner")).alias("m")).select("probe", F.col("m.partner").alias("partner"))
    out = materialise(met.select(F.least("probe", "partner").alias("a"), F.greatest("probe", "partner").alias("b")).distinct(), "pairs")
    for x in (live, bands, rest):
        release(x)
    return out


def keep_representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component one document, with all its columns: that of the least doc_id, a null one being the greatest.

    Of rows that share that doc_id one text stays, and of equal rows one.  Documents without words have no component
    and stay.
    """
    texts, candidates = _sets(docs, width, percent)
    # else the texts' hashes and every round's broadcasts stay in the executors' heaps
    labels = link_components(candidates, percent, lambda: collect_garbage(docs.sparkSession))
    collect_garbage(docs.sparkSession)
    worded = texts.where("key is not null")
    grouped = worded.withColumn("label", F.col("key")) if labels is None else _with_label(worded, labels)
    least = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("least"))
    stay = materialise(least.select(F.col("least.doc_id").alias("stay_id"), F.col("least.tie").alias("stay_tie")), "stay")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    text, key = (F.col(names[docs.columns.index(c)]) for c in ("text", "doc_id"))
    has_words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # a doc_id and text name one component, so the texts meet their row by both and are shuffled once
    marked = own.where(has_words).withColumns({"_id": F.coalesce(key.cast("long"), F.lit(0)), "_null": key.isNull(), "_tie": F.xxhash64(text)})
    stay = stay.select(F.coalesce("stay_id", F.lit(0)).alias("_id"), F.col("stay_id").isNull().alias("_null"), F.col("stay_tie").alias("_tie"))
    kept = marked.join(stay, ["_id", "_null", "_tie"], "left_semi").dropDuplicates(["_id", "_null", "_tie"])
    return kept.select(*names).unionByName(own.where(~has_words)).toDF(*docs.columns)
