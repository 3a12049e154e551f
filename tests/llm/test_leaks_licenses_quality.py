import random
import time

import numpy as np
import pytest

from inkspan.llm import decontaminate as dc
from inkspan.llm import licenses, quality

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghiklmnoprstuv") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force():
    rng = random.Random(8)
    items = [(k, prose(n, rng)) for k, n in enumerate([20, 15, 18, 19, 16])] + [(90, "ab"), (91, None), (92, "")]
    texts = [prose(200, rng) for _ in range(40)]
    for i in range(0, 40, 2):
        item = list(items[i % 5][1])
        for _ in range(i % 9):
            p = rng.randrange(len(item))
            kind = rng.random()
            if kind < 0.4:
                item[p] = rng.choice("xyz")
            elif kind < 0.7:
                del item[p]
            else:
                item.insert(p, rng.choice("xyz"))
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + "\n" + "".join(item).upper().replace(" ", ",  ") + " " + texts[i][at:]
    found = dc.Benchmark(items)
    for text in texts:
        got = {k for k, *_ in found.leaks(text)}
        clean = dc.as_text(dc.normalise(text))
        for k, item in items[:5]:
            whole = dc.as_text(dc.normalise(item))
            if len(whole) <= dc.LEAST_PART:
                want = edits(whole, clean) <= dc.edit_budget(len(whole))
                assert (k in got) == want or (edits(whole, clean) >= dc.edit_budget(len(whole)) and k not in got)
            elif edits(whole, clean) <= dc.edit_budget(len(whole)) // 2:
                assert k in got
    assert [x[0] for x in found.leaks("so ab it is")] == [90] and found.leaks("cab") == []


@pytest.mark.parametrize("most", [200_000, 0])
def test_runs_match_brute_force(monkeypatch, most):
    """All pairs of equal q-grams, put together to runs by hand."""
    monkeypatch.setattr(dc, "MOST_HITS", most)
    rng = random.Random(1)
    for t in range(20):
        letters = "ab " if t % 2 else "abcdef "
        items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(3, 60))) * rng.choice([1, 1, 3])) for i in range(4)]
        found = dc.Benchmark(items, q=4)
        points = dc.normalise("".join(rng.choice(letters) for _ in range(200)) + items[0][1] * 2)
        codes = dc.gram_codes(points, 4)
        hits = {(k, i, a) for k, p in enumerate(found.points) for i, x in enumerate(dc.gram_codes(p, 4).tolist()) for a, y in enumerate(codes.tolist()) if x == y}
        want = []
        for k, i, a in hits:
            if (k, i - 1, a - 1) not in hits:
                n = 1
                while (k, i + n, a + n) in hits:
                    n += 1
                want.append((k, i, a, n))
        assert sorted(zip(*(x.tolist() for x in found.runs(codes, points)), strict=True)) == sorted(want)


def test_every_region_is_found():
    rng = random.Random(3)
    item = prose(60, rng)
    found = dc.Benchmark([(1, item), (2, "ab c")])
    edited = item[:100] + "#x" + item[101:180] + item[181:]
    text = " ".join([prose(30, rng), item, prose(30, rng), edited, prose(10, rng), item[60:220], "ab c", prose(5, rng), "ab, c"])
    got = found.leaks(text)
    assert [x[0] for x in got].count(1) == 3 and [x[0] for x in got].count(2) == 2
    assert (len(item), 0) in [x[3:] for x in got] and all(x[4] <= dc.edit_budget(x[3]) for x in got)
    spans = sorted(x[1:3] for x in got)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(found.leaks(text, first_only=True)) == 1


def test_repetitive_texts_take_no_pairs():
    phrase = "lorem ipsum dolor sit "
    for item, text, n in ((phrase * 400, phrase * 2800, 7), ("a" * 400, "a" * 60_000, 150)):
        found = dc.Benchmark([(1, item)])
        began = time.process_time()
        got = found.leaks(text)
        assert time.process_time() - began < 2
        assert len(got) == n and all(x[4] == 0 for x in got) and sum(x[2] - x[1] for x in got) > 0.95 * len(text)


def test_part_of_a_long_item():
    rng = random.Random(1)
    item = prose(120, rng)
    found = dc.Benchmark([(1, item)])
    (leak,) = found.leaks(prose(300, rng) + " " + item[200:420] + " " + prose(50, rng))
    assert leak[0] == 1 and 190 <= leak[3] <= 240
    assert not found.leaks(prose(300, rng) + " " + item[200:270] + " " + prose(50, rng))


def test_leaks_in_spark(spark, docs_of):
    rng = random.Random(2)
    item = prose(30, rng)
    texts = [None, "", prose(50, rng), prose(9, rng) + " " + item + ". x", (prose(3000, rng) + " ") * 3 + item]
    benchmark = spark.createDataFrame([(1, item, "e"), (2, None, "e"), (3, prose(20, rng), "e")], "item_id long, text string, extra string")
    docs = docs_of([*texts, texts[3]], [1, 2, None, 4, 5, 4])
    for most in (10, 10_000):
        got = sorted((r.doc_id, r.item_id, r.matched, r.edits) for r in dc.find_leaks(docs, benchmark, most).collect())
        assert got == [(4, 1, len(item), 0), (4, 1, len(item), 0), (5, 1, len(item), 0)]
        kept = dc.drop_leaking(docs, benchmark, most)
        assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2]
    assert dc.find_leaks(docs, benchmark.limit(0)).count() == 0 and dc.find_leaks(docs.limit(0), benchmark).count() == 0


def test_licenses():
    m = licenses.Matcher()
    text = "Some prose. Released under the MIT License.\nLicensed under the Apache License, Version 2.0. More.\nLicensed under CC BY-NC 4.0.\nA licensed driver drove by.\nThis work is licensed under the GNU General Public License, version 3.\nCopyright 2020 Some Body. All rights reserved."
    got = m.scan(text)
    assert [g[2] for g in got] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "all-rights-reserved"]
    assert all(text[g[0] : g[1]].strip() and not g[5] and not g[6] for g in got)
    long = licenses.TEMPLATES[3][1].replace("free of charge", "at no charge")
    (x,) = m.scan(long)
    assert x[2] == "MIT" and x[5] == ["free", "of"] and x[6] == ["at", "no"]
    assert m.scan(None) == m.scan("") == m.scan("nothing here") == []
    assert licenses.differences(["copyright", "...", "all"], ["copyright", "2020", "me", "all"]) == ([], [])
    for k, (_, t) in enumerate(licenses.TEMPLATES):  # each template saves most for itself
        s = m.savings(licenses.wording(t))
        assert s[k] == max(s)


def test_licenses_in_spark(spark, docs_of):
    docs = docs_of([None, "", "x " * 30000 + ". Released under the MIT License.", "All rights reserved.", "All rights reserved."], [None, 1, 2, 3, 3])
    got = sorted((r.doc_id, r.license, r.block) for r in licenses.scan_licenses(docs).collect())
    assert got == [(2, "MIT", "Released under the MIT License."), (3, "all-rights-reserved", "All rights reserved."), (3, "all-rights-reserved", "All rights reserved.")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


@pytest.fixture()
def graded(spark, docs_of):
    rng = random.Random(6)
    texts = [" ".join(x + rng.choice(["%%%", "***"]) for x in prose(60, rng).split()) if i % 5 == 0 else prose(rng.randrange(5, 90), rng) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), "x") for i in range(0, 300, 2)] + [(None, 1, "x"), (7, None, "x")], "doc_id long, quality int, text string")
    return docs_of([*texts, None, "", texts[0], texts[1]], [*range(300), 300, None, 0, 1]), labels


def test_resampling(graded):
    docs, labels = graded
    rows = quality.resample(docs, labels).collect()
    assert len(rows) == 304
    by = {r.doc_id: r for r in rows}
    assert all(by[i].kept == int(i % 5 != 0) for i in range(300)) and by[300].log_weight == 0
    kept = quality.keep_sampled(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == sorted((r.doc_id is None, r.doc_id) for r in rows if r.kept)
    assert sum(r.kept for r in quality.resample(docs, labels, k=10).collect()) == 10
    assert all(r.kept for r in quality.resample(docs, labels.limit(0)).collect())
    assert quality.resample(docs.limit(0), labels).count() == 0


def test_inclusion_follows_the_importance_weights():
    """Of texts whose log weights differ by d the heavier are drawn first with odds of e^d, and the noise decides single cases."""
    rng = np.random.default_rng(2)
    gap = np.array([quality.noise(i, "a") + 1.0 - quality.noise(i, "b") for i in range(20_000)])
    assert abs((gap > 0).mean() - 1 / (1 + np.exp(-1.0))) < 0.01
    weights = rng.standard_normal(400)
    times = np.zeros(400)
    for seed in range(600):
        keys = weights + np.array([quality.noise(i, "t", seed) for i in range(400)])
        times[np.argsort(-keys)[:8]] += 1
    expected = np.exp(weights) / np.exp(weights).sum() * 8 * 600  # nearly, as 8 of 400 are few
    order = np.argsort(weights)
    for part in np.array_split(order, 8):
        assert times[part].sum() == pytest.approx(expected[part].sum(), rel=0.15)
    assert len({int(np.argmax(weights + np.array([quality.noise(i, "t", s) for i in range(400)]))) for s in range(30)}) > 5


def test_weights_are_log_importance_ratios(graded):
    """Against a brute-force model: the log of the product of the n-grams' probabilities under the two models."""
    docs, labels = graded
    ratio, cut = quality.fit(docs, labels)
    rows = docs.collect()
    raw = np.full(quality.BUCKETS, 0.5)
    for r in rows:
        for g in quality.ngrams(r.text).tolist():
            raw[g] += 1
    good = [t for t, q, _ in quality.labelled_sample(docs, labels) if q][::2]
    target = np.full(quality.BUCKETS, 0.5)
    for t in good:
        for g in quality.ngrams(t).tolist():
            target[g] += 1
    p, q = np.log(target / target.sum()), np.log(raw / raw.sum())
    brute = {(r.doc_id, r.text): sum(p[g] - q[g] for g in quality.ngrams(r.text).tolist()) for r in rows}
    got = {(r.doc_id, r.text): r for r in quality._weighed(docs.select("doc_id", "text"), ratio, ["doc_id", "text"], 5).collect()}
    assert all(got[k].log_weight == pytest.approx(w, rel=1e-4, abs=1e-3) for k, w in brute.items()) and len(got) == len(brute)
    assert all(r.sample_key == pytest.approx(r.log_weight + quality.noise(r.doc_id, r.text, 5)) for r in got.values())
    k = 40
    kept = {(r.doc_id, r.text) for r in quality.keep_sampled(docs, labels, k, seed=5).select("doc_id", "text").collect()}
    brute_kept = sorted(rows, key=lambda r: -got[r.doc_id, r.text].sample_key)[:k]
    assert kept == {(r.doc_id, r.text) for r in brute_kept}


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.standard_normal(3000), np.full(2000, 0.5)])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for k in (1, 2, 900, 1500, 4999, 5000):
        assert quality.kth_largest(df, "x", k, most=50) == np.sort(v)[::-1][k - 1]


def test_cut():
    assert quality.best_cut(np.array([0.0, 1, 2, 10, 11]), np.array([0.0, 0, 0, 1, 1])) == 6
    assert quality.best_cut(np.array([1.0, 1]), np.array([1.0, 1])) == -np.inf


def test_every_template_matches_its_notice():
    m = licenses.Matcher()
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        notice = template.replace("...", "(c) 2020 Some Body.")
        words = notice.split(" ")
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        for text in (notice, "\n".join(lines), "\r\n".join(lines), "/*\n * " + "\n * ".join(lines) + "\n */", "# " + "\n# ".join(lines), prose(80) + ": " + notice + " " + prose(80)):
            (x,) = m.scan(text)
            assert (x[2], x[5], x[6]) == (name, [], []) and licenses.wording(text[x[0] : x[1]])[:1] == licenses.wording(notice)[:1]
            assert licenses.TEMPLATES[x[3]][0] == licenses.TEMPLATES[k][0]


def test_recall_on_altered_notices():
    """Notices with as many random changes of words as are allowed, wrapped and commented, are found, and prose about licenses isn't."""
    m = licenses.Matcher()
    rng = random.Random(11)
    found = tried = 0
    for k, (name, template) in enumerate(licenses.TEMPLATES):
        for _ in range(8):
            words = template.replace("...", "2021 Some Body").split()
            for _ in range(rng.randint(0, m.allowed[k])):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice([[], [words[i], "indeed"], ["other"]])
            lines = [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
            text = prose(30, rng) + ". " + rng.choice([" ", "\n * ", "\n# "]).join(lines) + " " + prose(30, rng)
            tried += 1
            found += name in [x[2] for x in m.scan(text)]
    assert found / tried >= 0.9, found / tried  # a word replaced is one lacking and one beyond
    for text, want in [("This file is licensed under the MIT license.", "MIT"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("Licensed under the Apache License Version 2", "Apache-2.0"), ("Code in this directory is available under the GNU General Public License, version 3.", "GPL-3.0")]:
        assert [x[2] for x in m.scan(text)] == [want], text
    for text in ("He had a license to drive under the bridge.", "The public license office, version two of it, was mozilla brown.", "a software foundation free of charge"):
        assert m.scan(text) == []


def test_compression_ranks_overlapping_blocks():
    m = licenses.Matcher([("short", "all rights reserved"), ("long", "copyright some body all rights reserved for the work and its parts everywhere"), ("other", "copyright some body no rights reserved for the work and its parts everywhere")], 0.2)
    (x,) = m.scan("copyright some body all rights reserved for the work and its parts everywhere")
    assert x[2] == "long" and x[5:] == ([], [])
    saved = [m.saving(k, licenses.wording(m.templates[1][1])) for k in range(3)]
    assert saved[1] == max(saved) and saved[1] > saved[0] + licenses.MARGIN


def test_license_stretches():
    m = licenses.Matcher()
    apache = licenses.TEMPLATES[6][1]
    text = "Copyright 2020 Some Body\n\n" + apache.replace("; ", ";\n") + "\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + licenses.TEMPLATES[7][1].replace(", ", ",\n")
    assert [(x[2], x[3]) for x in m.scan(text)] == [("Apache-2.0", 6), ("Apache-2.0", 7)]
    assert [x[2] for x in m.scan("This work is licensed under the GNU Lesser General Public License,\nversion 3.")] == ["LGPL-3.0"]
    assert len(m.scan("All rights reserved. " * 50)) == 50
    rng = random.Random(3)
    for k, (name, template) in enumerate(licenses.TEMPLATES):  # every allowed number of changes is found
        words = [w for w in licenses.wording(template) if w != "..."]
        for _ in range(m.allowed[k]):
            del words[rng.randrange(1, len(words) - 1)]
        if m.allowed[k]:
            assert name in [x[2] for x in m.scan(prose(50, rng) + "\n" + "\n".join(words) + "\n" + prose(50, rng))]


class Asked:
    """A compressor that notes when it is used."""

    def __init__(self, k, compressor, seen):
        self.k, self.compressor, self.seen = k, compressor, seen

    def compress(self, data):
        self.seen.setdefault(data.decode(), set()).add(self.k)
        return self.compressor.compress(data)


def test_every_template_is_ranked_on_each_candidate_block():
    m = licenses.Matcher()
    seen = {}
    m.with_template = [Asked(k, c, seen) for k, c in enumerate(m.with_template)]
    text = "This work is licensed under the\nGNU General Public License, version 3. " + prose(20) + " Licensed under CC BY 4.0."
    assert [x[2] for x in m.scan(text)] == ["GPL-3.0", "CC-BY-4.0"]
    assert "licensed under cc by 4.0" in seen and all(ks == set(range(len(m.templates))) for ks in seen.values())


def test_named_block_matches_brute_force():
    """Templates that fit a block within MARGIN of the one that saves most; of them the fewest differences."""
    rng = random.Random(5)
    named = 0
    for _ in range(40):
        base = prose(24, rng).split()
        templates = [(str(k), " ".join(rng.choice([w, w, w, w, w, w, w, rng.choice(WORDS)]) for w in base)) for k in range(5)] + [("gap", " ".join([*base[:8], "...", *base[12:]]))]
        m = licenses.Matcher(templates, 0.4)
        for block in (base, base[1:], [*base[:10], "more", *base[10:]], base[:6], prose(20, rng).split()):
            saved = m.savings(block)
            found = [(licenses.differences(w, block), k) for k, (_, _, w) in enumerate(m.templates)]
            fits = [(sum(map(len, d)), -saved[k], k, *d) for d, k in found if sum(map(len, d)) <= m.allowed[k]]
            top = max((-x[1] for x in fits), default=0)
            want = min((x for x in fits if -x[1] > top - licenses.MARGIN), default=None)
            assert m.name(block) == (want and (want[2], -want[1], *want[3:]))
            named += want is not None
    assert 60 < named < 200
