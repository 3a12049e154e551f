import zlib

import numpy as np
import pytest

from inkspan.llm import toxicity as tox


def made(rng, n, bad):
    """Invented prose; bad texts hold words of two families."""
    syllables = ["ta", "re", "no", "mi", "su", "lo", "ken", "dar", "vi", "po"]
    texts = []
    for i in range(n):
        words = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(5, 300)))]
        if bad[i]:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["zounds", "grumph" + str(rng.choice(syllables))])))
        texts.append(" ".join(words).capitalize() + ".")
    return texts


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in tox.new_parameters(6, 9, 3).items()}
    p["V"], p["E"] = rng.standard_normal(p["V"].shape) / 5, rng.standard_normal(p["E"].shape) / 5
    n, steps = 3, 5
    words = rng.integers(1, 7, (steps, n))
    where, bucket = np.repeat(np.arange(n * steps), 2), rng.integers(0, 9, 2 * n * steps)
    mask = (np.arange(steps)[:, None] < np.array([5, 3, 1])[None, :]).astype(float)[:, :, None]
    args = (words, (where, bucket), np.full(len(where), 0.5), mask, np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5]))
    _, g = tox.loss_and_gradients(p, *args)
    for k in "VE":  # gradients of embeddings come as (rows, values)
        own, values = g[k]
        g[k] = np.zeros_like(p[k])
        g[k][own] = values
    for k, i in [("E", (int(bucket[0]), 2)), ("V", (int(words[0, 1]), 4)), ("Wf", (1, 4)), ("Wb", (4, 20)), ("cf", (3,)), ("Uf", (2, 9)), ("Ub", (5, 17)), ("A", (3, 2)), ("v", (4,)), ("w", (11,)), ("o", (0,))]:
        kept = p[k][i]
        losses = []
        for d in (1e-2, -1e-2):
            p[k][i] = kept + d
            losses.append(tox.loss_and_gradients(p, *args)[0])
        p[k][i] = kept
        assert g[k][i] == pytest.approx((losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-4), k


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000, 1001):
        met = {k for s in tox.windows(n) for k in range(s, min(n, s + tox.WINDOW))}
        assert met == set(range(n)) and all(b - a <= tox.STRIDE for a, b in zip(tox.windows(n), tox.windows(n)[1:]))


def test_held_out_accuracy_and_spark(spark):
    rng = np.random.default_rng(5)
    bad = rng.random(420) < 0.25
    texts = made(rng, 420, bad)
    texts[7], bad[7] = None, False
    texts[8], bad[8] = "", False
    texts[9] = texts[9] + " " + " ".join(["nomi suta"] * 3000)
    rows = [(i, t, "en", "s", 0.5, "x") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0.5, "x"), (3, texts[3], "en", "s", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, words string").repartition(3)
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad.tolist())] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == 422
    by = {r.doc_id: r for r in got}
    held = [i for i in range(420) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in got if r.held_out} == set(held) and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert by[7].score == by[8].score == 0 and by[None].score == by[0].score
    right = np.mean([by[i].predicted == bad[i] for i in held])
    assert right > 0.95, right
    # the long text's toxicity, if any, is in its first words
    assert by[9].predicted == int(bad[9])
    assert tox.toxicity(docs.limit(0), labels).count() == 0
    none = tox.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 422 and {r.score for r in none} == {0.0}
    kept = tox.score_documents(docs, None)
    assert kept.columns == [*docs.columns, "toxic_score", "is_toxic"]


def test_one_toxic_word_among_rare_ones_is_learned():
    rng = np.random.default_rng(9)
    bad = rng.random(600) < 0.3
    texts = made(rng, 600, bad)
    model = tox.train(list(zip(texts[:400], bad[:400].astype(int).tolist(), strict=True)))
    assert "zounds" in model["words"] and len(model["words"]) < 200  # rare words of toxic texts have no embedding
    scores = tox.Scorer(model).scores([tox.words_of(t) for t in texts[400:]])
    assert np.mean((scores >= tox.THRESHOLD) == bad[400:]) > 0.97
    # without its embeddings the network knows nothing
    blank = model | {"p": model["p"] | {"V": 0 * model["p"]["V"], "E": 0 * model["p"]["E"]}}
    assert len(set(np.round(tox.Scorer(blank).scores([tox.words_of(t) for t in texts[400:] if len(t) > 400]), 6))) == 1
    # the place of a word within the window matters, so the units are in use
    a, b = tox.Scorer(model).scores([["suta"] * 10 + ["zounds"] + ["mi"] * 20, ["zounds"] + ["suta"] * 10 + ["mi"] * 20])
    assert a != b


def naive_score(model, text):
    """Word by word, window by window."""
    if model is None or not (words := tox.words_of(text)):
        return 0.0
    p = {k: v.astype(np.float64) for k, v in model["p"].items()}

    def sig(x):
        return 1 / (1 + np.exp(-x))

    best = -np.inf
    for s in tox.windows(len(words)):
        inputs = []
        for w in words[s : s + tox.WINDOW]:
            grams = tox.grams_of(w)
            known = [p["E"][model["grams"][g]] for g in grams if g in model["grams"]]
            inputs.append(np.concatenate([p["V"][model["words"].get(w, 0)], sum(known, np.zeros(tox.OF_GRAMS)) / len(grams) ** 0.5]))
        sides = []
        for k in "fb":
            h, out = np.zeros(tox.HIDDEN), []
            for x in inputs if k == "f" else inputs[::-1]:
                a, g = x @ p[f"W{k}"] + p[f"c{k}"], h @ p[f"U{k}"]
                z, r = sig(a[:8] + g[:8]), sig(a[8:16] + g[8:16])
                h = z * h + (1 - z) * np.tanh(a[16:] + r * g[16:])
                out.append(h)
            sides.append(out if k == "f" else out[::-1])
        states = np.concatenate(sides, axis=1)
        e = np.exp(np.tanh(states @ p["A"]) @ p["v"])
        best = max(best, float((e / e.sum()) @ states @ p["w"] + p["o"][0]))
    return float(sig(best))


def test_scores_match_brute_force():
    rng = np.random.default_rng(4)
    bad = rng.random(200) < 0.3
    texts = made(rng, 200, bad)
    model = tox.train(list(zip(texts, bad.astype(int).tolist(), strict=True)))
    some = [*texts[:40], "", "one", "zounds", " ".join(texts[:30])]
    assert np.allclose(tox.Scorer(model).scores([tox.words_of(t) for t in some]), [naive_score(model, t) for t in some], atol=1e-4)


def test_near_copies_are_left_out_by_label_and_row():
    from inkspan.llm.toxicity import without_near_copies

    base = [f"w{i}" for i in range(60)]
    clean, toxic = " ".join(base), " ".join([*base[:30], "slur", *base[31:]])
    assert [y for _, y in without_near_copies([(clean, 0), (toxic, 1), (clean, 0), (clean + " end", 0), (toxic, 1), ("", 0)])] == [0, 1]
    # each of these shares a part with a different earlier row, and none shares most with one
    parts = [[f"p{k}x{i}" for i in range(40)] for k in range(4)]
    rows = [(" ".join(part), 0) for part in parts] + [(" ".join(sum(parts, [])), 0)]
    assert len(without_near_copies(rows)) == 5
