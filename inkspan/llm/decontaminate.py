"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item leaks into a document where a stretch of the document is
within an edit budget of the item, or of a part of it of at least LEAST_PART
characters.  A stretch of m characters with at most k edits shares at least
m + 1 - q - k q of its q-grams with the item, at diagonals (place in the
document minus place in the item) that differ by at most k.  So:

1. all q-grams of the document are looked up among those of the benchmark; hits
   that follow each other on a diagonal are one run, and of a q-gram that occurs
   often on both sides only the ends of runs are looked at, so repetitive texts
   don't make all pairs;
2. runs are counted in diagonal bands, each overlapping the next by half, and in
   windows of the item, so that a match of any place falls whole into a band;
3. windows whose distinct shared q-grams reach the lemma's bound are retained;
4. each retained region is verified by a banded alignment with the item, the one
   with most shared q-grams first.

Every region of a document is reported, but for those that overlap one already
reported for the same item.  A region longer than ALIGN_CHARS comes in pieces.

Text is compared in lower case, with runs of anything but letters and digits as
one space.  Benchmarks of up to MOST_ITEM_CHARS characters are sent to all
tasks; larger ones are cut into parts of that size, each of which all documents
pass in turn, so every document meets every item.

Edge cases: null or empty texts and items match nothing; an item shorter than
LEAST_PART must be found whole, and one shorter than q characters is matched
exactly, between spaces; rows with the same doc_id each count; null doc_ids are
kept; an empty table, or benchmark, gives no rows; of the documents only doc_id
and text are read for matching, and filtering keeps all their columns.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import forgetting, worker_cache

Q = 12
#: Edits allowed for each character of a match.
EDIT_SHARE = 0.06
#: Characters of an item that are a leak by themselves; a shorter item has to be there whole.
LEAST_PART = 120
#: Characters of an item that are aligned at once; bounds the alignment's memory.
ALIGN_CHARS = 3000
#: Hits that are listed before runs are looked for; beyond that only the ends of runs are.
MOST_HITS = 200_000
MOST_ITEM_CHARS = 4_000_000

#: Stands for no character, at an item's ends; one more does at a document's.
_NONE = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Code points below this are looked up; those above stand for themselves.
TABLE = 0x30000


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Lower case of each letter and digit, a space for all else."""
    out = np.full(TABLE, 32, np.uint32)
    for c in range(TABLE):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: str | None) -> np.ndarray:
    """Code points in lower case, with any run of other characters than letters and digits as one space."""
    if not text:
        return np.zeros(0, np.uint64)
    p = np.frombuffer(text.encode("utf-32-le"), "<u4")
    p = np.where(p < TABLE, _table()[np.minimum(p, TABLE - 1)], p)
    blank = p == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    p = p[keep]
    return p[int(len(p) > 0 and p[0] == 32) : len(p) - int(len(p) > 1 and p[-1] == 32)].astype(np.uint64)


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


def gram_codes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit codes of all q-grams of code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # codes of 1, 2, 4, ... characters, put together as q's binary digits say
    power, size, out, done = points, 1, None, 0
    while True:
        if q & size:
            part = power[done : done + n]
            out = part if out is None else _join(out, part)
            done += size
        if done == q:
            return out if q > 1 else _join(out, out)
        power, size = _join(power[:-size], power[size:]), 2 * size


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _ODD
    out ^= out >> np.uint64(29)
    out += b
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def edit_budget(length: int) -> int:
    return int(length * EDIT_SHARE)


class Benchmark:
    """The q-grams of a set of items, and windows of the items to look for."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q):
        self.q = q
        clean = [(i, normalise(t)) for i, t in items]
        self.items = [i for i, t in clean if len(t)]
        self.points = [t for _, t in clean if len(t)]
        codes, owner, place, before, after = [], [], [], [], []
        for k, p in enumerate(self.points):
            g = gram_codes(p, q)
            codes.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
            before.append(np.concatenate([[_NONE], p[: max(0, len(g) - 1)]])[: len(g)].astype(np.int64))
            after.append(np.concatenate([p[q:], [_NONE]])[: len(g)].astype(np.int64))
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(self.codes, kind="stable")
        self.codes = self.codes[order]
        self.owner = np.concatenate(owner)[order] if codes else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if codes else np.zeros(0, np.int64)
        #: The characters around each q-gram.
        self.before, self.after = (np.concatenate(x)[order] if codes else np.zeros(0, np.int64) for x in (before, after))
        self.bits = 1 << max(16, (len(self.codes) * 16).bit_length())
        self.filter = np.zeros(self.bits, bool)
        self.filter[self._slot(self.codes)] = True
        self.short = [(k, as_text(t)) for k, t in enumerate(self.points) if len(t) < q]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(65 - self.bits.bit_length())).astype(np.int64)

    def runs(self, codes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the document, q-grams) of every run of shared q-grams on a diagonal."""
        at = np.flatnonzero(self.filter[self._slot(codes)])
        first = np.searchsorted(self.codes, codes[at], side="left")
        times = np.searchsorted(self.codes, codes[at], side="right") - first
        at, first, times = at[times > 0], first[times > 0], times[times > 0]
        before = np.concatenate([[_NONE + 1], points]).astype(np.int64)[at]
        after = np.concatenate([points, [_NONE + 1]]).astype(np.int64)[at + self.q]
        starts, ends = (self._ends(at, first, times, own, theirs) for own, theirs in ((before, self.before), (after, self.after)))
        item, place, where = starts
        return item, place, where, ends[1] - place + 1

    def _ends(self, at, first, times, beside, items_beside):
        """(item, place in the item, place in the document) of the hits whose neighbours differ, by item, diagonal and place."""
        if int(times.sum()) <= MOST_HITS:
            k = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            where, keep = np.repeat(at, times), np.repeat(beside, times) != items_beside[k]
            k, where = k[keep], where[keep]
        else:
            ks, wheres = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            order = np.lexsort((beside, first))
            cut = np.flatnonzero((np.diff(first[order]) != 0) | (np.diff(beside[order]) != 0)) + 1
            for group in np.split(order, cut):  # places of one q-gram with one neighbour
                i, n = int(first[group[0]]), int(times[group[0]])
                other = i + np.flatnonzero(items_beside[i : i + n] != beside[group[0]])
                ks.append(np.repeat(other, len(group)))
                wheres.append(np.tile(at[group], len(other)))
            k, where = np.concatenate(ks), np.concatenate(wheres)
        item, place = self.owner[k], self.place[k]
        order = np.lexsort((place, where - place, item))
        return item[order], place[order], where[order]

    def leaks(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item_id, first and end character in the normalised text, length in the item, edits) of every region; of the first if first_only."""
        points = normalise(text)
        if not len(points) or not self.items:
            return []
        found = []
        if self.short:
            padded = f" {as_text(points)} "
            for k, t in self.short:
                at = padded.find(f" {t} ")
                while at >= 0:
                    found.append((self.items[k], at, at + len(t), len(t), 0))
                    at = padded.find(f" {t} ", at + len(t) + 1) if not first_only else -1
        codes = gram_codes(points, self.q)
        if not len(codes) or (first_only and found):
            return found
        item, place, where, n = self.runs(codes, points)
        if not len(item):
            return found
        cut = np.flatnonzero(np.diff(item)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
            k = int(item[i])
            if int(n[i:j].sum()) >= self._bound(min(len(self.points[k]), LEAST_PART)):
                found += [(self.items[k], *r) for r in self._regions(k, place[i:j], where[i:j], n[i:j], points, first_only)]
                if found and first_only:
                    break
        return found

    def _bound(self, window: int) -> int:
        """Least shared q-grams of a window with as many edits as its budget."""
        return max(1, window + 1 - self.q - edit_budget(window) * self.q)

    def _regions(self, k: int, place: np.ndarray, where: np.ndarray, n: np.ndarray, points: np.ndarray, first_only: bool) -> list[tuple[int, int, int, int]]:
        own = self.points[k]
        window, budget = min(len(own), LEAST_PART), edit_budget(min(len(own), LEAST_PART))
        bound, width, grams = self._bound(window), 2 * max(1, budget), len(own) - self.q + 1
        taken, found = np.zeros(len(points) + 1, bool), []

        def add(region) -> None:
            if not taken[region[0] : region[1]].any():
                taken[region[0] : region[1]] = True
                found.append(region)

        for at in np.sort(where[(place == 0) & (n == grams)]).tolist():  # the whole item without an edit
            add((at, at + len(own), len(own), 0))
            if first_only:
                return found
        diagonal = where - place
        low = int(diagonal.min())
        bands = []
        for shift in (0, width // 2):  # bands of `width` diagonals, overlapping by half
            band = (diagonal - low + shift) // width
            order = np.argsort(band, kind="stable")
            cut = np.flatnonzero(np.diff(band[order])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
                total = int(n[order[i:j]].sum())
                if total >= bound:
                    bands.append((-total, low + int(band[order[i]]) * width - shift + width // 2, order[i:j]))
        bands.sort(key=lambda x: x[:2])
        span = window - self.q + 1  # q-grams of a window
        for _, middle, group in bands:
            p, m, w = place[group], n[group], where[group]
            if taken[int(w.min()) : int((w + m).max()) + self.q - 1].all():
                continue
            steps = np.bincount(p, minlength=grams + 1) - np.bincount(p + m, minlength=grams + 1)
            covered = np.cumsum(steps)[:grams] > 0
            upto = np.concatenate([[0], np.cumsum(covered)])
            good = np.flatnonzero(upto[span:] - upto[:-span] >= bound)  # first places of the windows that reach the bound
            if not len(good):
                continue
            cut = np.flatnonzero(np.diff(good) > window)
            for i, j in zip([0, *(cut + 1).tolist()], [*cut.tolist(), len(good) - 1], strict=True):
                shared = int(good[i]) + np.flatnonzero(covered[good[i] : good[j] + span])
                a, z = int(shared[0]), int(shared[-1]) + self.q
                for x in range(a, max(a + 1, z - window), ALIGN_CHARS):  # pieces of a long region
                    y = z if x + ALIGN_CHARS >= z - window else x + ALIGN_CHARS
                    if taken[max(0, x + middle) : max(0, y + middle)].any():
                        continue
                    got = self._align(own, x, y, middle, points, window, width)
                    if got:
                        add(got)
                        if first_only and found:
                            return found
        return found

    def _align(self, own: np.ndarray, a: int, z: int, middle: int, points: np.ndarray, window: int, margin: int):
        """Banded alignment of the item's stretch around [a, z): the longest part within the budget."""
        spare = window
        # no further than the document reaches, as what lies beyond can't be aligned
        a, z = max(0, a - spare, min(a, -middle)), min(len(own), z + spare, max(z, len(points) - middle))
        half = margin + edit_budget(z - a)
        lo = max(0, a + middle - half)
        hi = min(len(points), z + middle + half)
        text, piece = points[lo:hi], own[a:z]
        if not len(text) or not len(piece):
            return None
        base = a + middle - lo  # where the piece's first character stands in text, give or take
        matched = _banded_matches(piece, text, base, half)
        if matched is None:
            return None
        pieces, texts = matched
        # the densest stretch: matched characters of the item, errors between them
        return _best_stretch(pieces, texts, a, lo, len(own), window)


def _banded_matches(piece: np.ndarray, text: np.ndarray, base: int, half: int):
    """Places of the characters that a best banded global-in-the-piece alignment matches."""
    m, n = len(piece), len(text)
    width = 2 * half + 1
    big = 1 << 20
    cost = np.full((m + 1, width), big, np.int32)
    offsets = np.arange(width) - half  # column c of row i is text place i + base + offset
    j0 = base + offsets
    cost[0, (j0 >= 0) & (j0 <= n)] = 0
    ramp = np.arange(width)
    for i in range(1, m + 1):
        j = i + base + offsets
        ok = (j >= 0) & (j <= n)
        same = np.zeros(width, bool)
        inner = (j >= 1) & (j <= n)
        same[inner] = text[j[inner] - 1] == piece[i - 1]
        diagonal = cost[i - 1] + np.where(same, 0, 1)
        diagonal[j < 1] = big
        up = np.full(width, big, np.int32)
        up[:-1] = cost[i - 1, 1:] + 1
        row = np.minimum(diagonal, up)
        row[~ok] = big
        row = np.minimum.accumulate(row - ramp) + ramp  # text characters left out
        row[~ok] = big
        cost[i] = row
    c = int(np.argmin(cost[m]))
    if cost[m, c] >= big:
        return None
    i, pieces, texts = m, [], []
    while i > 0:
        j = i + base + int(offsets[c])
        here = int(cost[i, c])
        if j >= 1 and text[j - 1] == piece[i - 1] and cost[i - 1, c] == here:
            pieces.append(i - 1)
            texts.append(j - 1)
            i -= 1
        elif j >= 1 and cost[i - 1, c] + 1 == here:
            i -= 1
        elif c + 1 < width and cost[i - 1, c + 1] + 1 == here:
            i, c = i - 1, c + 1
        elif c > 0 and cost[i, c - 1] + 1 == here:
            c -= 1
        else:
            return None
    return np.array(pieces[::-1], np.int64), np.array(texts[::-1], np.int64)


def _best_stretch(pieces: np.ndarray, texts: np.ndarray, a: int, lo: int, whole: int, window: int):
    """The longest stretch of matched characters whose edits stay in the budget; None if shorter than the window."""
    if not len(pieces):
        return None
    gaps = np.maximum(np.diff(pieces), np.diff(texts)) - 1
    errors = np.concatenate([[0], np.cumsum(gaps)])
    best = None
    i = 0
    # errors <= share * length, as a difference of prefix values: errors - share * place
    slack = errors - EDIT_SHARE * pieces
    order = np.minimum.accumulate(slack[::-1])[::-1]  # least slack from here on
    for i in range(len(pieces)):
        limit = slack[i] + EDIT_SHARE
        j = int(np.searchsorted(order, limit, side="right")) - 1  # order ascends
        if j > i or (j == i and window <= 1):
            size = int(pieces[j] - pieces[i]) + 1
            if best is None or size > best[2]:
                best = (int(texts[i]) + lo, int(texts[j]) + 1 + lo, size, int(errors[j] - errors[i]))
        if best and best[2] >= len(pieces) - i:
            break
    if best is None:
        return None
    missing = whole - best[2] if whole <= window else 0  # a short item has to be there whole, edits at its ends included
    if whole <= window:
        return best if best[3] + missing <= edit_budget(whole) else None
    return best if best[2] >= window - edit_budget(window) else None


def item_parts(benchmark: DataFrame, most_chars: int = MOST_ITEM_CHARS) -> list[list[tuple[int, str]]]:
    """The items in parts of a bounded size."""
    parts, held = [[]], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        if held and held + len(r["text"]) > most_chars:
            parts.append([])
            held = 0
        parts[-1].append((r["item_id"], r["text"]))
        held += len(r["text"])
    return parts


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_chars: int = MOST_ITEM_CHARS) -> DataFrame:
    """doc_id, item_id and the match: first and end character in the normalised text, characters of the item, edits."""
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"]] + [T.StructField(n, T.IntegerType()) for n in ("start", "end", "matched", "edits")])
    out = None
    for part in item_parts(benchmark, most_chars):
        found = docs.select("doc_id", "text").mapInArrow(_search(part, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(part: list[tuple[int, str]], schema: T.StructType):
    def run(batches):
        import pyarrow as pa

        worker_cache("benchmark", int)
        items = Benchmark(part)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1)):
                for leak in items.leaks(text.as_py()):
                    at.append(i)
                    rows.append(leak)
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[k] for r in rows], pa.int32()) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return run


def drop_leaking(docs: DataFrame, benchmark: DataFrame, most_chars: int = MOST_ITEM_CHARS) -> DataFrame:
    """The documents, with all their columns, in which no item leaks."""
    for part in item_parts(benchmark, most_chars):
        docs = docs.mapInArrow(forgetting(_without(part, docs.columns.index("text"))), docs.schema)
    return docs


def _without(part: list[tuple[int, str]], text_at: int):
    def run(batches):
        import pyarrow as pa

        worker_cache("benchmark", int)
        items = Benchmark(part)
        for b in batches:
            yield b.filter(pa.array([not items.leaks(t.as_py(), first_only=True) for t in b.column(text_at)], pa.bool_()))

    return run
