import random
import zlib

from pyspark import SparkContext
from pyspark.sql import functions as F

from test_ngramjoin import brute
from test_toxicity import naive_score

import corpus_pipeline as cp
from inkspan.llm import common, ngramjoin, quality, toxicity
from inkspan.llm.decontaminate import Benchmark
from inkspan.llm.tokens import ChunkEncoder, default_vocabulary


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    leak = prose(40)
    texts, kinds = [], []
    for i in range(260):
        t, kind = prose(rng.randrange(20, 120)), "clean"
        if i % 7 == 0:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "zounds")
            t, kind = " ".join(w), "toxic"
        elif i % 7 == 1:
            t, kind = " ".join(x + rng.choice(["%%%", "***"]) for x in t.split()), "junk"
        elif i % 7 == 2 and i > 10:
            copied = next(k for k in range(i - 1, -1, -1) if kinds[k] == "clean" and k % 7 == 3)
            t, kind = texts[copied], "copy"
        elif i % 35 == 4:
            t, kind = t + " " + leak + " " + prose(5), "leak"
        texts.append(t)
        kinds.append(kind)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, piece long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(kinds[i] != "junk"), int(kinds[i] == "toxic")) for i in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in at.collect()}
        at = cp.materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        after = {r.doc_id: r for r in at.collect()}
        assert all(before[k] == after[k] for k in after)
        left.append(set(after))
    # the same by brute force: scores window by window, all weights sorted, all pairs of sets, every item in every text
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels, toxicity.third_held_out))
    rest = {i: t for i, t in enumerate(texts) if naive_score(model, t) < toxicity.THRESHOLD}
    assert left[0] == set(rest)
    ratio, cut = quality.fit(docs.where(F.col("doc_id").isin(list(rest))), labels)
    weight = {i: sum(float(ratio[g]) for g in quality.ngrams(t).tolist()) for i, t in rest.items()}
    k = sum(w >= cut for w in weight.values())
    rest = {i: rest[i] for i in sorted(rest, key=lambda i: -(weight[i] + quality.noise(i, rest[i])))[:k]}
    assert left[1] == set(rest)
    assert left[2] == {c for _, _, c in brute(sorted(rest.items()))}
    toxic, junk, copies, leaks = ({i for i in range(260) if kinds[i] == k} for k in ("toxic", "junk", "copy", "leak"))
    clean = {i for i in range(260) if kinds[i] == "clean"}
    assert not left[0] & toxic and clean <= left[0]
    assert not left[1] & junk and len(clean - left[1]) <= 1
    assert not left[2] & copies and clean & left[1] <= left[2]
    found = Benchmark([(1, leak)])
    assert left[3] == {k for k in left[2] if not found.leaks(texts[k])} and not left[3] & leaks
    rows = cp.run(spark, str(tmp_path)).collect()
    e = ChunkEncoder(default_vocabulary())
    assert {r.doc_id for r in rows} == left[3]
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(e.encode(texts[r.doc_id]) + bytes(4)) and r.piece == 0
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert cp.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(r.length for r in rows)


def test_edge_rows_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and tables without rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t), 1) for i, t in enumerate(prose)] + [(100, None, None, None, None, None), (101, "", "en", None, 0, 2), (None, prose[3], "en", "s", 1, 3), (None, prose[3], "en", "s", 1, 3), (102, prose[4], "en", "s", 1, 4), (5, prose[5], "en", "s", len(prose[5]), 1), (103, "so " * 60_000, "en", "s", 180_000, 5), (104, "x" * 100_000, "en", "s", 100_000, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, length int"
    for name, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, None), (2, ""), (None, prose[9])] if some else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = cp.run(spark, f"{tmp_path}/full").collect()
    kept = {r.doc_id for r in out}
    assert {100, 101, 103, 104, 4} <= kept and 102 not in kept and 9 not in kept
    lengths = {}
    for r in out:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048 and sum(r.length for r in out if r.doc_id == 100) == 1
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_tasks_give_their_memory_back(spark, docs_of, monkeypatch):
    """Every Python task of a stage, not only one that remembered something; idle workers stay beside the next ones."""
    calls, used = [], []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": lambda self, n: calls.append(n)})())
    assert list(common.forgetting(lambda batches: iter(batches))([1, 2])) == [1, 2] and calls == [0]
    monkeypatch.undo()
    docs = docs_of([" ".join(f"w{i // 4}x{j + (j == i % 4) * 1000}" for j in range(60)) for i in range(40)])
    kind, own = type(docs), type(docs).mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: used.append(f) or own(self, f, *a, **k))
    cp.drop_near_copies(spark, docs, "").count()
    assert len(used) > 3
    cp.pack_sequences(spark, docs, "").count()
    benchmark = spark.createDataFrame([(1, " ".join(f"leak{i}" for i in range(60)))], "item_id long, text string")
    cp.drop_leaking(docs, benchmark).count()
    assert {f.__qualname__ for f in used} == {"forgetting.<locals>.task"}


def test_samples_start_no_second_kind_of_workers(spark, docs_of, monkeypatch):
    """A Python list given to createDataFrame() runs tasks with a daemon of their own, which stays on each executor."""
    docs = docs_of([f"some words of text {i}" for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(30)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))

    def refused(*_, **__):
        raise AssertionError("rows went through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    rows = toxicity.training_rows(docs, labels, toxicity.third_held_out)
    assert rows and sorted(y for _, y in rows) == sorted(int(int(t.split()[-1]) % 3 == 0) for t, _ in rows)
    sample = quality.labelled_sample(docs, labels)
    assert sample and all(y == int(t.split()[-1]) % 2 for t, y, _ in sample)
    table = common.small_table(spark, {"a": ("int64", [1, None]), "b": ("int32", [2, 3])})
    assert table.dtypes == [("a", "bigint"), ("b", "int")] and [tuple(r) for r in table.collect()] == [(1, 2), (None, 3)]


def test_stages_begin_with_collected_heaps(spark, docs_of, tmp_path, monkeypatch):
    """What one stage made the executors' heaps grow doesn't stay beside the next one; here the driver is the executor."""
    docs = docs_of([f"some words of text {i // 2}" for i in range(12)])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a passage")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def full_collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    seen = []
    for name in ("training_rows", "keep_sampled", "keep_representatives", "drop_leaking", "pack"):
        monkeypatch.setattr(cp, name, lambda *_: seen.append(full_collections()) or [])
    monkeypatch.setattr(cp, "without_toxic", lambda *_: docs)
    for _, stage in cp.STAGES:
        before = full_collections()
        stage(spark, docs, str(tmp_path))
        assert seen[-1] > before
    assert len(seen) == len(cp.STAGES)
    # near copies: the heap that the texts' hashes filled isn't kept through the rounds that link them
    sets, label = ngramjoin._sets, ngramjoin._with_label
    monkeypatch.setattr(ngramjoin, "_sets", lambda *a: (sets(*a), seen.append(full_collections()))[0])
    monkeypatch.setattr(ngramjoin, "_with_label", lambda *a: seen.append(full_collections()) or label(*a))
    words = [f"w{i // 2} x y z{i // 4} " + " ".join(f"v{i // 4}x{j}" for j in range(60)) for i in range(12)]
    assert ngramjoin.keep_representatives(docs_of(words)).count() == 3
    assert len(seen) > len(cp.STAGES) + 2 and all(b > a for a, b in zip(seen[len(cp.STAGES) :], seen[len(cp.STAGES) + 1 :]))
