import functools
import random

import pytest

from inkspan.llm import ngramjoin as nj


def brute(rows, percent=80, links=False):
    """(doc_id, set size, least doc_id of the component) by comparing all pairs of sets of word tuples."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    if links:
        return {frozenset((i, j)) for i in range(len(rows)) for j in range(i) if sets[i] != sets[j] and (both := len(sets[i] & sets[j])) and 100 * both >= percent * len(sets[i] | sets[j])}
    return sorted(((k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = ["", None, "one two", "One  two", "one two three", " \n\t", "a b c d e", "A b c d e f", "x" * 3000, "w1 " * 4000]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4, 25])):  # copies with edits, some chained
            new = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = new
            if rng.random() < 0.2:
                new = new + passage
            texts.append(rng.choice([" ", "\n", "  "]).join(new).upper() if rng.random() < 0.1 else " ".join(new))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(6)]) for _ in range(30)]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "rounds", "best", "hot"), [(1, 3, 8, 32), (2, 0, 1, 1)])
def test_components_match_brute_force(spark, docs_of, monkeypatch, seed, rounds, best, hot):
    monkeypatch.setattr(nj, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(nj, "BEST_ROUNDS", best)
    monkeypatch.setattr(nj, "_deal", functools.partial(nj._deal, batch_hashes=2000, hot=hot))
    monkeypatch.setattr(nj, "TILE", 4)
    rows = corpus(seed)
    rows += [(None, rows[12][1]), (None, "only here and nowhere else at all"), rows[15]]
    got = nj.components(docs_of([t for _, t in rows], [k for k, _ in rows])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_pairs_match_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 4)
    rows = corpus(3)
    pairs, members = nj.similar_pairs(docs_of([t for _, t in rows], [k for k, _ in rows]))
    place = {k: i for i, (k, _) in enumerate(rows)}
    by_key = {}
    for r in members.collect():
        by_key.setdefault(r.key, []).append(place[r.doc_id])
    got = {frozenset((i, j)) for r in pairs.collect() for i in by_key[r.a] for j in by_key[r.b]}
    assert got == brute(rows, links=True) and len(got) > 50
    none, _ = nj.similar_pairs(docs_of([None, "a b c d e f"]))
    assert none.count() == 0


def test_many_buckets_and_a_hot_shingle(spark, docs_of):
    """Ten thousand buckets: what is dealt doesn't grow with them, and a shingle of all texts is dealt as one count a batch."""
    texts = [f"all texts start with these words t{i} " + " ".join(f"u{i}x{k}" for k in range(40)) for i in range(300)]
    few, many = ({r.target for r in rows} and rows for rows in (docs_of(texts).select("doc_id", "text", nj.F.lit(0).cast("long")).repartition(1).mapInArrow(nj._deal(n, 5), "target int, batch long, kind int, texts binary, hashes binary, hot binary, hot_counts binary, ids array<long>, keys array<long>, ties array<long>").collect() for n in (4, 10_000)))
    size = [sum(len(r.texts) + len(r.hashes) + len(r.hot) for r in rows if r.kind) for rows in (few, many)]
    assert size[1] < 1.5 * size[0]
    hot = [r for r in many if r.kind and r.hot]
    assert [sum(len(r.hot) // 5 for r in hot), {int(x) for r in hot for x in nj.np.frombuffer(r.hot_counts, "<u4")}] == [2, {300}]
    rows = list(enumerate([*texts, texts[0] + " end", texts[7] + " end"]))
    got = nj.components(docs_of([t for _, t in rows]), buckets=10_000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_representative_stays(spark, docs_of):
    rows = corpus(5)[:120]
    extra = [(None, rows[14][1]), (None, rows[14][1]), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at ALL"), (None, None), (None, ""), rows[20], rows[20], (rows[21][0], "the same number stands for another text here"), (77_777, None), (77_777, None)]
    rows += extra
    docs = docs_of([t for _, t in rows], [k for k, _ in rows])
    kept = nj.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    groups = {}
    pairs = brute(rows, links=True)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for pair in pairs:
        a, b = sorted(pair)
        up[root(a)] = root(b)
    words = [tuple((t or "").lower().split()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if words[i] and words[i] == words[j]:
                up[root(i)] = root(j)
    for i, (k, t) in enumerate(rows):
        if words[i]:
            groups.setdefault(root(i), []).append((k is None, k or 0, k, t))
    least = {g: min(x[:2] for x in own) for g, own in groups.items()}
    assert len(got) == len(groups) + sum(not w for w in words)  # one of each group, and all without words
    allowed = {(k, t) for g, own in groups.items() for last, n, k, t in own if (last, n) == least[g]}
    assert all(not (t or "").split() or (k, t) in allowed for k, t in got)
    assert nj.keep_representatives(docs.limit(0)).count() == 0


def test_gaps_round_trip():
    rng = random.Random(4)
    for top in (1, 3, 300, 100_000):
        owners = nj.np.sort(nj.np.array([rng.randrange(top) for _ in range(500)]))
        assert (nj._from_gaps(nj._gaps(owners)) == owners).all()
    assert len(nj._from_gaps(nj._gaps(nj.np.zeros(0, int)))) == 0


def test_empty_table(spark, docs_of):
    assert nj.components(docs_of([])).collect() == []
    assert [tuple(r) for r in nj.components(docs_of([None, ""], [4, 5])).collect()] in ([(4, 0, 4), (5, 0, 5)], [(5, 0, 5), (4, 0, 4)])


def test_shared_hashes_and_owners_take_few_bytes(spark, docs_of):
    """Beyond its bucket a hash is a rank, as wide as the shared hashes need, however many buckets there are; an owner is some bits."""
    texts = [" ".join(f"u{i // 2}x{k}" for k in range(60)) + f" end{i}" for i in range(60)]
    rows = list(enumerate(texts))
    for buckets in (7, 100_000):
        _, candidates = nj._sets(docs_of(texts), 5, 80, buckets)
        got = candidates.select("shared", "tokens").collect()
        assert len(got) == 60 and all(r.shared == 56 and len(r.tokens) <= 4 * r.shared for r in got)
        assert sorted(map(tuple, nj.components(docs_of(texts), buckets=buckets).collect()), key=repr) == brute(rows)
    rng = random.Random(6)
    for top, most in ((500, 0.25), (40_000, 0.75)):
        owners = nj.np.sort(nj.np.array([rng.randrange(top) for _ in range(15_000)]))
        assert len(nj._gaps(owners)) < most * len(owners) and (nj._from_gaps(nj._gaps(owners)) == owners).all()
