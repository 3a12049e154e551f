"""Token-id files in Simple-8b word-aligned coding.

Documents are encoded with the tokenizers library, get an end id, and are
written in ascending doc_id order.  A file set is a table of blocks in the
shared folder (Spark's writer commits it, so a lost executor's half-written
output never counts).  A block is self-contained:

    magic "S8B1", then unsigned 32-bit: documents, ids, words, escapes
    document ids (int64 each), null flags (a byte each)
    offsets of the documents' first ids (unsigned 32-bit, documents + 1)
    places of escaped raw words (unsigned 32-bit each)
    words (unsigned 64-bit each), all little-endian

A word's top four bits are its selector, which says how many ids of how many
bits the other sixty hold.  Selector 0 is the escape: the next word is one raw
64-bit value.  The offsets let a reader unpack a block with array operations,
and reach each document in it.

Edge cases: a null or empty text is the end id alone; null doc_ids come first;
rows that share a doc_id each keep their place next to each other; an empty
table makes a file set without blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.common import bucket_count, crc32, id_boundaries, scratch_path, shuffle_partitions, worker_cache
from inkspan.llm.tokens import default_vocabulary, encoder

#: Fixed values of the format: selector: (ids in a word, bits of each).
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 0
MAGIC = b"S8B1"
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 16
#: A batch of encoded documents ends with the one that brings it to so many bytes.
BATCH_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _bits_of() -> np.ndarray:
    """How many bits each 16-bit value needs."""
    return np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each unsigned value needs."""
    table = _bits_of()
    if values.dtype == np.uint16:
        return table[values]
    out = np.zeros(len(values), np.uint8)
    rest = values.astype(np.uint64)
    for k in range(4):
        part = table[(rest & np.uint64(0xFFFF)).astype(np.uint16)]
        out = np.where(part > 0, part + np.uint8(16 * k), out)
        rest >>= np.uint64(16)
    return out


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned values, and the places of the raw words that follow an escape."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    padded = np.concatenate([values, np.zeros(60, values.dtype)])
    need = _bits(padded)
    # the most bits of the next 1, 2, 3, ... values; a selector with more ids has fewer bits, so those that fit are the last ones
    fits, most, width = np.zeros(n, np.uint8), need, 1
    for s in sorted(SELECTORS, reverse=True):
        count, bits = SELECTORS[s]
        while width < count:
            step = min(width, count - width)
            most = np.maximum(most[:-step], most[step:])
            width += step
        ok = most[:n] <= bits
        if not ok.any():
            break
        fits += ok
    # the chosen selectors: 0 of 14 fit means an escape, all 14 fit selector 1
    selector = np.where(fits > 0, len(SELECTORS) + 1 - fits.astype(np.int64), ESCAPE).astype(np.uint8)
    counts = np.ones(16, np.uint8)
    for s, (count, _) in SELECTORS.items():
        counts[s] = count
    jump = counts[selector].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    at = np.array(starts)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    wide = padded.astype(np.uint64)
    for s in np.unique(chosen).tolist():
        if s == ESCAPE:
            continue
        count, bits = SELECTORS[s]
        own = np.flatnonzero(chosen == s)
        first, word = at[own], words[own]
        for k in range(count):
            word |= wide[first + k] << np.uint64(bits * k)
        words[own] = word
    escaped = np.flatnonzero(chosen == ESCAPE)
    if len(escaped):
        words = np.insert(words, escaped + 1, wide[at[escaped]])
    return words, (escaped + 1 + np.arange(len(escaped))).astype(np.uint32)


def decode_words(words: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode_words()."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.zeros(16, np.int64)
    counts[ESCAPE] = 1
    for s, (count, _) in SELECTORS.items():
        counts[s] = count
    held = counts[chosen]
    held[raw] = 0
    first = np.cumsum(held) - held
    out = np.zeros(n + 60, np.uint64)
    is_raw = np.zeros(len(words), bool)
    is_raw[raw] = True
    for s in np.unique(chosen[~is_raw]).tolist():
        own = np.flatnonzero((chosen == s) & ~is_raw)
        if s == ESCAPE:
            out[first[own]] = words[own + 1]
            continue
        count, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        k = np.arange(count)
        out[first[own, None] + k] = (words[own, None] >> (k * bits).astype(np.uint64)) & mask
    return out[:n]


def encode_block(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    offsets = np.zeros(len(documents) + 1, "<u4")
    np.cumsum([len(d) for d in documents], out=offsets[1:])
    values = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    words, raw = encode_words(values)
    head = MAGIC + struct.pack("<4I", len(documents), len(values), len(words), len(raw))
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
    nulls = bytes(x is None for x in doc_ids)
    return head + ids + nulls + offsets.tobytes() + raw.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def decode_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, offsets of the documents' ids, all ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, words, escapes = struct.unpack_from("<4I", payload, 4)
    at = 20
    ids = np.frombuffer(payload, "<i8", docs, at).tolist()
    at += 8 * docs
    ids = [None if null else x for x, null in zip(ids, payload[at : at + docs], strict=True)]
    at += docs
    offsets = np.frombuffer(payload, "<u4", docs + 1, at)
    at += 4 * (docs + 1)
    raw = np.frombuffer(payload, "<u4", escapes, at)
    at += 4 * escapes
    return ids, offsets, decode_words(np.frombuffer(payload, "<u8", words, at), raw, n)


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode every text and write the file set at `path`: files, blocks and documents in ascending doc_id order.

    Shards are ranges of doc_id cut at quantiles; their number grows with the
    input, and a file holds neighbouring ones.  Only encoded ids are shuffled,
    two or four bytes each.
    """
    vocabulary = vocabulary or default_vocabulary()
    cuts = np.array(id_boundaries(docs, bucket_count(docs)), dtype=np.int64)
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        e = encoder(vocabulary)
        narrow = e.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        for b in batches:
            key = b.column(0).cast(pa.int64())
            shard = np.searchsorted(cuts, pc.fill_null(key, -(1 << 63)).to_numpy(zero_copy_only=False), side="right")
            first, own, held = 0, [], 0
            for i, t in enumerate(b.column(1)):
                ids = e.encode(t.as_py()) + end
                own.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids)
                held += len(own[-1])
                if held >= BATCH_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first : i + 1], pa.int32()), key[first : i + 1], pa.array([2 if narrow else 4] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["shard", "doc_id", "width", "ids"])
                    first, own, held = i + 1, [], 0

    def blocks(batches):
        import pyarrow as pa

        worker_cache("words", _bits_of.cache_clear)  # the chunks are forgotten before files are written
        shard, number, keys, own, held = None, 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([encode_block(keys, own)], pa.binary())], names=["shard", "block", "n_ids", "payload"])

        for b in batches:
            for s, key, width, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if own and (s != shard or held >= BLOCK_IDS):
                    yield flush()
                    number = 0 if s != shard else number + 1
                    keys, own, held = [], [], 0
                elif s != shard:
                    number = 0
                shard = s
                ids = np.frombuffer(ids.as_py(), "<u2" if width == 2 else "<u4")
                keys.append(key)
                own.append(ids)
                held += len(ids)
        if own:
            yield flush()

    encoded = docs.select("doc_id", "text").mapInArrow(tokenise, "shard int, doc_id long, width int, ids binary")
    shards = len(cuts) + 1
    files = min(shards, max(shuffle_partitions(docs.sparkSession), shards // 8))
    ordered = encoded.repartitionById(files, F.expr(f"cast(shard * {files}L div {shards} as int)")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first())
    writer = ordered.mapInArrow(blocks, "shard int, block int, n_ids long, payload binary").write.option("compression", "uncompressed")
    for k in ("page.size", "block.size"):  # else a hundred blocks, however large, make a page that is copied as a whole
        writer = writer.option(f"parquet.{k}.row.check.min", "1")
    writer.parquet(path)


def block_starts(files: DataFrame) -> DataFrame:
    """shard, block and first (ids of all blocks before it): sums within a shard after sums of whole shards, of which there are MOST_BUCKETS at most."""
    within = Window.partitionBy("shard").orderBy("block")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    blocks = files.select("shard", "block", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inside"))
    return blocks.join(F.broadcast(shards), "shard").select("shard", "block", (F.col("earlier") + F.col("inside")).alias("first"))


def read_ids(spark: SparkSession, path: str, include_ids: bool = False) -> DataFrame:
    """Every document of a file set: doc_id, start (ids before it), n_tokens, ids_crc32; with include_ids also the ids as unsigned 32-bit bytes."""
    files = spark.read.schema("shard int, block int, n_ids long, payload binary").parquet(path)

    def decode(batches):
        import pyarrow as pa

        names = ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * include_ids
        for b in batches:
            for shard, block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids, offsets, values = decode_block(payload.as_py())
                flat = values.astype("<u4").tobytes()
                ends = offsets.astype(np.int64)
                parts = [flat[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [pa.array([shard] * len(ids), pa.int32()), pa.array([block] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array([crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * include_ids, names=names)

    found = files.select("shard", "block", "payload").mapInArrow(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * include_ids)
    placed = found.join(block_starts(files), ["shard", "block"])  # after decoding, so no payload is shuffled
    return placed.select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * include_ids)


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the file set into the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, end_id)
    return read_ids(docs.sparkSession, path)
