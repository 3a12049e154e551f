import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.llm import idfiles, packing, urlrules
from inkspan.llm.tokens import ChunkEncoder, default_vocabulary

TEXTS = ["", None, "Hello, world. It's a test!!", "<|endoftext|> x<|startoftext|>y", "ünï çödé… end.\u00a0NBSP \u2003x", "a" * 5000, "word " * 9000, "1234 5.6%, don't 'tis ''s .'s x.'s", "\x1ca\x1db \x85 c", "e\u0301 \u0301x", "Σ ΑΣ ΣΑ İi", "tail?.\n*** $$$ A.B.C. (x)|"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_give_the_librarys_ids(tokenizer):
    e = ChunkEncoder(default_vocabulary(), cache_chunks=10)
    for t in TEXTS * 2:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == ids_of(tokenizer, t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZ19.,!?'’…*$(|<>)- \t\n\x1c\u00a0\u0301éßΣﬁ①ñ")), max_size=40))
def test_chunks_give_the_librarys_ids_for_any_text(text):
    global _E, _T
    try:
        e, t = _E, _T
    except NameError:
        from tokenizers import Tokenizer

        e, t = _E, _T = ChunkEncoder(default_vocabulary()), Tokenizer.from_file(default_vocabulary())
    assert np.frombuffer(e.encode(text), "<u4").tolist() == ids_of(t, text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=40))
def test_every_plan_places_every_piece_once(histogram):
    for share, groups in packing.SCHEMES:
        got = defaultdict(int)
        for count, contents in packing.plan_runs(histogram, 64, share, groups):
            assert sum(x * k for x, k in contents) <= 64
            for x, k in contents:
                got[x] += count * k
        assert dict(got) == {k: v for k, v in histogram.items() if v}


def test_pack(spark, docs_of, tokenizer):
    docs = docs_of(TEXTS + ["same text here"] * 40, ids=[None, 5, 5] + list(range(10, 10 + len(TEXTS) + 37)))
    rows = packing.pack(docs, include_ids=True).collect()
    want = [[*ids_of(tokenizer, t), 0] for t in TEXTS + ["same text here"] * 40]
    assert sum(r.length for r in rows) == sum(map(len, want))
    by_sequence = defaultdict(list)
    for r in rows:
        assert r.length <= 2048 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(map(len, want)) // 2048)
    long = sorted((r.piece, r.ids) for r in rows if r.doc_id == 13)
    assert np.frombuffer(b"".join(x for _, x in long), "<u4").tolist() == want[6]
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_words_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, raw = idfiles.encode_words(v)
    assert idfiles.decode_words(words, raw, len(v)).tolist() == values


def test_block_round_trip():
    docs = [np.arange(5, dtype=np.uint32), np.zeros(0, np.uint32), np.full(200, 49406, np.uint32)]
    ids, offsets, values = idfiles.decode_block(idfiles.encode_block([3, None, -1], docs))
    assert ids == [3, None, -1] and offsets.tolist() == [0, 5, 5, 205] and values.tolist() == np.concatenate(docs).tolist()
    with pytest.raises(ValueError):
        idfiles.decode_block(b"none" + bytes(40))


def test_files_and_blocks_ascend(spark, docs_of, tmp_path, monkeypatch):
    """The files in the order of their names, their rows as they stand, hold the documents in ascending doc_id order."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(idfiles, "BLOCK_IDS", 40)
    texts = [f"a b c {i} " * (i % 30) for i in range(700)]
    idfiles.write_ids(docs_of([*texts, "x " * 300_000, None], [*((i * 37) % 700 for i in range(700)), 900, None]), f"{tmp_path}/ids")
    found = []
    for f in sorted((tmp_path / "ids").glob("*.parquet")):
        t = pq.read_table(f)
        found.append([(s, b, idfiles.decode_block(x)[0]) for s, b, x in zip(*(t.column(c).to_pylist() for c in ("shard", "block", "payload")), strict=True)])
    rows = [r for f in found for r in f]
    assert len([f for f in found if f]) > 1 and [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    assert [k for _, _, ids in rows for k in ids] == [None, *range(700), 900]
    back = {r.doc_id: (r.start, r.n_tokens) for r in idfiles.read_ids(spark, f"{tmp_path}/ids").collect()}
    at = 0
    for k in [None, *range(700), 900]:
        assert back[k][0] == at
        at += back[k][1]


def test_token_files(spark, docs_of, tokenizer):
    ids = [7, 3, None, 40, 41, 42, 43, 44, 45, 2, 1, 0]
    docs = docs_of(TEXTS, ids)
    got = {r.doc_id: r for r in idfiles.token_files(docs).collect()}
    at = 0
    for k, text in sorted(zip(ids, TEXTS, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        own = np.array([*ids_of(tokenizer, text), 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert idfiles.token_files(docs.limit(0)).count() == 0
    twice = idfiles.token_files(docs_of(["a b", "a b", "c"], [1, 1, 0])).collect()
    assert sorted((r.doc_id, r.start) for r in twice) == [(0, 0), (1, 2), (1, 5)]


def test_encoded_batches_stay_small_and_chunks_go_before_files(spark, docs_of, tokenizer, tmp_path, monkeypatch):
    import pyarrow as pa

    from inkspan.llm import common, tokens

    docs, steps = docs_of(["a b"]), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a: (steps.append(f), real(self, f, *a))[1])
    idfiles.write_ids(docs, f"{tmp_path}/ids")
    tokenise, blocks = steps
    texts = [None, *["word " * 4000] * 600, "", "x"]
    rows = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 603)], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    found = list(tokenise(iter([rows.slice(0, 0), rows])))
    assert len(found) > 1 and all(sum(map(len, b.column("ids").to_pylist()[:-1])) < idfiles.BATCH_BYTES for b in found)
    assert [k for b in found for k in b.column("doc_id").to_pylist()] == [None, *range(1, 603)]
    want = {t: np.array([*ids_of(tokenizer, t), 2], "<u2").tobytes() for t in set(texts)}
    assert [x for b in found for x in b.column("ids").to_pylist()] == [want[t] for t in texts]
    assert tokens._encoder.cache_info().currsize == 1
    made = list(blocks(iter(found)))
    assert tokens._encoder.cache_info().currsize == 0 and "tokens" not in common._REMEMBERED
    assert [k for b in made for x in b.column("payload").to_pylist() for k in idfiles.decode_block(x)[0]] == [None, *range(1, 603)]


def test_pages_of_large_blocks_stay_small(spark, docs_of, tmp_path):
    """Parquet looks at a page's size after a hundred rows only, unless told."""
    idfiles.write_ids(docs_of([f"{i} " + "zebra quartz " * 100_000 for i in range(40)]), f"{tmp_path}/ids")
    hadoop, largest, rows = spark._jvm.org.apache.parquet.hadoop, 0, 0
    for f in (tmp_path / "ids").glob("*.parquet"):
        path = spark._jvm.org.apache.hadoop.fs.Path(str(f))
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
        for group in reader.getFooter().getBlocks():
            own = next(c for c in group.getColumns() if c.getPath().toDotString() == "payload")
            pages = reader.readOffsetIndex(own)
            largest = max([largest, *(pages.getCompressedPageSize(i) for i in range(pages.getPageCount()))])
            rows += group.getRowCount()
        reader.close()
    assert rows == 40 and largest < 2 << 20, largest


URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q#f", "http://example.com/en/", "http://m.example.com/en/x", "http://x.net/es/", "http://net/fr/a/b", "http://x.net/ES/", "http://x.net/esa", "no scheme", None, "", "://", "http://com", "http://acom/x", "http://a.com?x/", "ftp://b.org/y://z.com/", "http://.com/", "http://example.com:80/en/", "http://é.Ünet/es/", "http://x.net/es/\n?", "http://" + "a." * 5000 + "example.com/en/x", "http://" + "." * 3000 + "net/es/", "http://x.net/es/" + "y/" * 50_000]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(raw) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlrules, "BROADCAST_BYTES", 32 << 20 if broadcast else -1)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("org", "", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "r", 1), (3, URLS[3], "h", "r", 1)], "page_id long, url string, host string, rule string, salt int")
    got = sorted(map(tuple, urlrules.judge_urls(pages, urlrules.rule_table(spark, rules)).collect()), key=repr)
    want = [(i, u, *judge(u, rules)) for i, u in enumerate(URLS)] + [(None, URLS[0], *judge(URLS[0], rules)), (3, URLS[3], *judge(URLS[3], rules))]
    assert got == sorted(want, key=repr)
    assert urlrules.judge_urls(pages.limit(0), urlrules.rule_table(spark, rules)).count() == 0
    none = urlrules.judge_urls(pages, urlrules.rule_table(spark, rules).limit(0)).collect()
    assert len(none) == len(want) and {r.verdict for r in none} == {"allow"}
