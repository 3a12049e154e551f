import hashlib
from collections import Counter

import numpy as np

from inkspan.llm.fingerprints import edited, fingerprint, fingerprints, likeness, sample, shingle_hashes, with_next
from inkspan.llm import htmltext
from inkspan.llm.htmltext import extract, extract_pages

ARTICLE = "<h1>Title here</h1><p>First para,\n with  <b>bold</b> text&amp;more.</p><p>Second&nbsp;one, it is <a href='/x'>linked</a>.<br>After break."
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body class="has-sidebar">
<header><div>Site name</div></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them. Really, many.</div>
<div class="ad">Buy this, now. And this, too. A long advert text, longer than the article by far.</div><article>{ARTICLE}</article>
<section id="comments"><article class="comment"><p>I do not agree, at all. Long comment, long, long, long, longer than all else here.</p></article></section>
<aside>More</aside><form>Name <input></form><!-- <p>hidden</p> --><footer>&copy; me</footer></body></html>"""
WANT = "Title here First para, with bold text&more. Second one, it is linked. After break."


def test_extract():
    assert extract(PAGE) == WANT
    assert extract(PAGE.replace("<article>", "<div class=post>", 1).replace("</article>", "</div>", 1).replace("</p><p>Second", "</p>" + "<p>Long text, with some words. And more of it, here.</p>" * 8 + "<p>Second")) == WANT.replace(" Second", " Long text, with some words. And more of it, here." * 8 + " Second")
    assert extract(PAGE[: PAGE.index("</article>")]) == WANT
    assert [extract(x) for x in (None, "", "<p></p>", "<script>x", "<!-- x")] == [""] * 5
    assert extract("plain a < b &lt;p&gt;") == "plain a < b <p>"
    assert extract("<article>" + "<p>word, word.</p>" * 20000 + "</article>") == " ".join(["word, word."] * 20000)
    assert extract("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>") == "one two a b c"


LINE = "Some words stand here, and they go on for a while. They end here."


def test_ratios_decide_and_names_only_break_ties():
    p = f"<p>{LINE}</p>"
    for page, want in [
        (f'<nav><a href=x>m</a></nav><article class="post related-post"><h1>T</h1>{p}</article>', f"T {LINE}"),
        (f'<div class="content notice">{p}{p}</div>', f"{LINE} {LINE}"),
        (f'<article><h1>T</h1>{p}<div class="search-term-alert">{p}</div></article>', f"T {LINE} {LINE}"),
        (f"<main><article><h1>A</h1>{p}</article><article><h1>B</h1>{p}</article></main>", f"A {LINE} B {LINE}"),
        (f"<article>{p}<ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>{p}</article>", f"{LINE} one two {LINE}"),
        ('<div class="ad">Buy this now, it is good. Buy, buy, and buy it again.</div><div><p>First line, here.</p><p>Second line.</p></div>', "First line, here. Second line."),
        (f"<div>Buy this now, it is good. Buy, buy, and buy.</div><div><h2>T</h2>{p * 4}</div>", " ".join(["T", *[LINE] * 4])),
        (f'<div class="comments">{p}</div><article></article>', ""),
        (f'<div class="page with-sidebar">{p}{p}<div class=sidebar>x, y. z</div></div>', f"{LINE} {LINE}"),
        (f"<article><p>One, two.</p><div class=ad>{LINE}</div><section class=comments>{p * 9}</section></article>", "One, two."),
        (f"<main><h1 id=search-options>Search</h1>{p}<div class=related><a href=1>More, more.</a></div></main>", f"Search {LINE}"),
        ("<p>only text", "only text"),
    ]:
        assert extract(f"<html><body>{page}</body></html>") == want, page


def test_path_ratios_match_brute_force():
    """Paths as whole strings, sums and smoothing spelled out."""
    import math
    import random

    rng = random.Random(5)
    page = "".join(rng.choice(["<div>", "</div>", "<p class=a>", "<p class=b>", "</p>", "<li>", "</li>", "one, two. ", "three! four ", "x"]) for _ in range(400))
    p = htmltext._Page(page)
    full = [(e, t) for e, t, _ in p.texts if t.strip()]

    def path(e):
        return "" if e == 0 else path(p.parents[e]) + "/" + next(shown for (_, shown), n in p.known.items() if n == p.paths[e])

    names = [path(e) for e, _ in full]
    series = []
    for f in (lambda t: len(t.strip()), lambda t: sum(c in ".,;:!?" for c in t)):
        mean = {n: [f(t) for m, (_, t) in zip(names, full, strict=True) if m == n] for n in set(names)}
        raw = [sum(mean[n]) / len(mean[n]) for n in names]
        kernel = [math.exp(-(d * d) / 2) for d in range(-2, 3)]
        series.append([sum(k * raw[min(max(i + d, 0), len(raw) - 1)] for k, d in zip(kernel, range(-2, 3), strict=True)) / sum(kernel) for i in range(len(raw))])
    want = [a * (1 + b) for a, b in zip(*series, strict=True)]
    elements = np.array([e for e, _ in full])
    got = htmltext.path_ratios(np.array(p.paths)[elements], np.array([len(t.strip()) for _, t in full], float), np.array([len(htmltext.PUNCTUATION.findall(t)) for _, t in full], float))
    assert np.allclose(got, want) and len(set(names)) > 5
    mean = sum(want) / len(want)
    least = min(htmltext.DEVIATIONS * (sum((x - mean) ** 2 for x in want) / len(want)) ** 0.5, max(want))
    assert htmltext.selected(got).tolist() == [x >= least - 1e-9 for x in want]


def test_broken_pages_take_linear_time():
    import time

    for page in ('<p a="x' * 150_000, "<p a='" * 170_000, '<i b="y\'>' * 100_000, "<div>" * 200_000 + "text", "<b>" * 100_000 + "x" + "<ul></ul>" * 60_000, "<div>x" * 160_000, "<" * 1_000_000, "<ul>" + "<li><b>x" * 120_000, "<p " + 'a="1" ' * 160_000 + ">t", '<p ' + '"' * 1_000_000 + ">", "<!--" * 250_000, "</p>" * 250_000):
        began = time.process_time()
        extract(page)
        assert time.process_time() - began < 2, page[:20]


def test_extract_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")]
    pages = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, extract_pages(pages).collect()), key=repr)
    assert got == sorted([(i, u, WANT if h else "", len(WANT) if h else 0) for i, u, h in rows], key=repr)
    assert extract_pages(pages.limit(0)).count() == 0


def jaccard(a, b):
    A, B = (Counter(shingle_hashes(x.lower().encode().split(), 2).tolist()) for x in (a, b))
    return sum((A & B).values()) / max(1, sum((A | B).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        n = int(rng.integers(5, 80))
        terms = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        wa, wb = rng.integers(0, 6, len(terms)), rng.integers(0, 6, len(terms))
        a, b = (sample(terms[w > 0], w[w > 0], samples=256) for w in (wa, wb))
        errors.append(likeness(a, b) - np.minimum(wa, wb).sum() / max(1, np.maximum(wa, wb).sum()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_fingerprint_cases():
    assert not fingerprint("").any() and not fingerprint(" \n").any() and not fingerprint(None).any()
    assert likeness(fingerprint(""), fingerprint("a")) == 0 and fingerprint("one").any()
    long = " ".join(f"w{i % 9000}" for i in range(20000))
    assert likeness(fingerprint(long), fingerprint(long.upper())) == 1
    assert abs(likeness(fingerprint(long), fingerprint(long[: len(long) // 2])) - jaccard(long, long[: len(long) // 2])) < 0.2


def test_fingerprints(spark, docs_of):
    texts = ["", None, "a b c d e", "x", "ünï " * 30, "same text twice", "same text twice", "z" * 9] + [f"text number {i} of many" for i in range(40)]
    ids = [(i * 7) % 48 - 5 for i in range(48)]
    got = {r.doc_id: r for r in fingerprints(docs_of(texts, ids)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(got) == 48
    for (k, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        new = edited(text, after)
        f, g, h = fingerprint(text), fingerprint(new), fingerprint(after)
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[k].fingerprint == f.astype(">u2").tobytes().hex() and got[k].edited_fingerprint == g.astype(">u2").tobytes().hex()
        assert got[k].near_edited == likeness(f, g) and got[k].near_next == likeness(f, h)
    assert fingerprints(docs_of([])).count() == 0
    one = fingerprints(docs_of(["abcd"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    odd = fingerprints(docs_of(["a b", "c d", "e f", None, "a b"], [None, 1, 1, None, 2])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in odd) == [(False, 0)] * 2 + [(True, 1)] * 2 + [(True, 2)]
    assert with_next(docs_of(texts, ids)).where("not tail").count() == 48


def test_names_that_are_no_boilerplate():
    long = "<p>Long text, with some words. And more of it, here.</p>" * 6
    said = " ".join(["Long text, with some words. And more of it, here."] * 6)
    for name in ("search-options", "related-work", "social-structure", "share-prices", "reply-to-critics"):
        assert extract(f"<article><h2 id='{name}'>Head</h2><section id='{name}'><p>Part of it.</p></section>{long}</article>") == "Head Part of it. " + said
    assert extract(f"<article><h2 class=related>Head</h2>{long}</article>") == "Head " + said
    for name in ("page with-sidebar", "no-sidebar", "sidebar", "page widget"):
        assert extract(f"<html><body><div class='{name}'>{long}</div><div class=footer>Imprint</div></body></html>") == said
    assert extract(f"<article><h1>Head</h1><div class=social>{long}</div></article>") == "Head " + said
    for name in ("related", "share-buttons", "social share", "cookie-notice", "ad", "comments"):
        assert extract(f"<article>{long}<div class='{name}'>Not this, at all.</div></article>") == said
        assert extract(f"<body><div class=post>{long}</div><div class='{name}'>Not this.</div></body>") == said
    assert extract(f"<article><p>Short, this.</p><div class=ad>{long}</div></article>") == "Short, this."
