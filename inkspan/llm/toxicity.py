"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is read as windows of WINDOW words, each overlapping the next by half.
The inputs of a word are a trained embedding of the word and trained embeddings
of its character n-grams.  Two gated recurrent units read a window in both
directions, attention pools their states, and a logistic unit gives the
window's score; a text's score is that of its highest window, over all windows
of the whole text.

Training runs in numpy on the driver, on at most MOST_TOXIC toxic and
MOST_CLEAN clean labelled rows (those whose hashed ids are least).  Of these, a
row is left out if one earlier row of its label shares most of its min-hashes;
there is no other limit.  Only whole texts are labelled, so the windows to learn
from are chosen: in the first round by log odds of words and n-grams that are
counted on other texts (these figures are no inputs), later by the network
itself.  Embeddings start at zero and shrink with every step, so those of words
and n-grams that few windows speak for stay zero and are left out of the model.
Last, the bias is set so that THRESHOLD parts the training texts.

Edge cases: a null or empty text, or one without words, scores 0; labels that
are null are ignored, and a doc_id labelled more than once counts as toxic if
one label says so; with no toxic or no clean training row every score is 0;
rows with a null doc_id are scored and not held out; repeated rows each give a
row; an empty table gives none; only doc_id and text of the documents are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import forgetting, small_table, worker_cache

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
#: Sizes of the trained embeddings of words and of character n-grams, and the n-grams' lengths.
OF_WORDS, OF_GRAMS, GRAMS = 8, 8, (5, 6)
#: A word or n-gram can have an embedding if so many training texts have it, or this share of the toxic ones' number.
LEAST_TEXTS, LEAST_SHARE = 3, 0.03
#: Size of the table that counts n-grams by hash.
SLOTS = 1 << 22
#: Rounds of choosing windows; passes over them in each, or as many as make STEPS steps in all, for small samples.
ROUNDS, EPOCHS, STEPS = 3, 4, 300
#: Learning rate and by how many powers of two it falls; an embedding's rate is so many times higher, and it shrinks as some windows can make it grow: KEEP of them, or a hundredth of the toxic texts.
RATE, FALL, SPEED, KEEP, DECAY = 0.01, 2.5, 600.0, 2.0, 0.02
THRESHOLD = 0.7
#: Standard errors taken off a log odds ratio.
ERRORS = 2.5
MOST_TOXIC, MOST_CLEAN = 1200, 2400
#: Words whose inputs are remembered in a task.
CACHE_WORDS = 200_000
#: Words of texts that are scored together.
AT_ONCE = 60_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str) -> list[str]:
    """Character n-grams of a word between its marked ends; the word itself where it is shorter."""
    marked = f"^{word}$"
    return [marked[i : i + n] for n in GRAMS for i in range(max(1, len(marked) - n + 1))]


class Inputs:
    """What the network reads of a word: its row among the known words (0: none), the rows of its known n-grams, and their share."""

    def __init__(self, words: dict[str, int], grams: dict[str, int]):
        self.words, self.grams = words, grams

    def __call__(self, word: str) -> tuple[int, list[int], float]:
        own = grams_of(word)
        return self.words.get(word, 0), [self.grams[g] for g in own if g in self.grams], len(own) ** -0.5


def windows(n: int) -> list[int]:
    """First words of the windows that cover n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_parameters(words: int, grams: int, seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h, a = OF_WORDS + OF_GRAMS, HIDDEN, ATTENTION

    def weights(*shape):
        return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

    p = {"V": np.zeros((words + 1, OF_WORDS), np.float32), "E": np.zeros((grams, OF_GRAMS), np.float32)}
    p["V"][0] = 0
    for k in "fb":
        p |= {f"W{k}": weights(d, 3 * h), f"c{k}": np.zeros(3 * h, np.float32), f"U{k}": weights(h, 3 * h)}
    return p | {"A": weights(2 * h, a), "v": weights(a), "w": weights(2 * h), "o": np.full(1, -1, np.float32)}


def _read(x, mask, u, backwards: bool, keep: bool):
    """States of one unit over projected inputs x (steps, windows, 3 * HIDDEN); mask (steps, windows, 1)."""
    steps, n, _ = x.shape
    h, size = np.zeros((n, HIDDEN), np.float32), HIDDEN
    out, kept = np.empty((steps, n, HIDDEN), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        g = h @ u
        zr = sigmoid(x[t, :, : 2 * size] + g[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        c = np.tanh(x[t, :, 2 * size :] + r * g[:, 2 * size :])
        m = mask[t]
        new = h + m * (1 - z) * (c - h)
        if keep:
            kept[t] = (h, z, r, c, g[:, 2 * size :], m)
        h = out[t] = new
    return out, kept


def _read_back(d_out, kept, u, backwards: bool):
    """Gradients of _read: of the projected inputs and of u."""
    steps, n, size = d_out.shape
    dx, du, dh = np.zeros((steps, n, 3 * size), np.float32), np.zeros_like(u), np.zeros((n, size), np.float32)
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        h, z, r, c, gc, m = kept[t]
        d = d_out[t] + dh
        dc = d * m * (1 - z) * (1 - c * c)
        dz = -d * m * (c - h) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        du += h.T @ dg
        dh = d * (1 - m * (1 - z)) + dg @ u.T
    return dx, du


def _pool(states, mask, p):
    s = np.tanh(states @ p["A"])
    e = np.where(mask[:, :, 0] > 0, s @ p["v"], -1e9)
    weight = np.exp(e - e.max(axis=0, keepdims=True))
    weight /= weight.sum(axis=0, keepdims=True)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    return pooled @ p["w"] + p["o"][0], pooled, weight, s


def forward(p, xf, xb, mask):
    """Logits of windows from their projected inputs."""
    a, _ = _read(xf, mask, p["Uf"], False, False)
    b, _ = _read(xb, mask, p["Ub"], True, False)
    return _pool(np.concatenate([a, b], axis=2), mask, p)[0]


def loss_and_gradients(p, words, grams, spread, mask, labels, weights):
    """Weighted logistic loss of windows, and its gradients.

    words (steps, windows) are rows of V; grams says which step of which window has which row of E, spread with what share.
    """
    steps, n = words.shape
    rows = words.reshape(-1)
    x = np.zeros((steps * n, OF_WORDS + OF_GRAMS), np.float32)
    x[:, :OF_WORDS] = p["V"][rows]
    for k in range(OF_GRAMS):
        x[:, OF_WORDS + k] = np.bincount(grams[0], p["E"][grams[1], k] * spread, steps * n)
    xf, xb = ((x @ p[f"W{k}"] + p[f"c{k}"]).reshape(steps, n, -1) for k in "fb")
    a, kept_a = _read(xf, mask, p["Uf"], False, True)
    b, kept_b = _read(xb, mask, p["Ub"], True, True)
    states = np.concatenate([a, b], axis=2)
    logit, pooled, weight, s = _pool(states, mask, p)
    q = sigmoid(logit)
    loss = float(-(weights * (labels * np.log(q + 1e-7) + (1 - labels) * np.log(1 - q + 1e-7))).sum())
    dl = (weights * (q - labels)).astype(np.float32)
    g = {"w": pooled.T @ dl, "o": np.array([dl.sum()], np.float32)}
    dp = dl[:, None] * p["w"][None, :]
    dw = (dp[None, :, :] * states).sum(axis=2)
    de = weight * (dw - (weight * dw).sum(axis=0, keepdims=True))
    ds = de[:, :, None] * p["v"] * (1 - s * s)
    g["v"] = s.reshape(-1, ATTENTION).T @ de.reshape(-1)
    g["A"] = states.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, ATTENTION)
    d_states = weight[:, :, None] * dp[None, :, :] + ds @ p["A"].T
    dx = np.zeros_like(x)
    for k, kept, part in (("f", kept_a, d_states[:, :, :HIDDEN]), ("b", kept_b, d_states[:, :, HIDDEN:])):
        d, g[f"U{k}"] = _read_back(part, kept, p[f"U{k}"], k == "b")
        d = d.reshape(steps * n, -1)
        g[f"W{k}"], g[f"c{k}"] = x.T @ d, d.sum(axis=0)
        dx += d @ p[f"W{k}"].T
    for k, of, share, at, first, size in (("V", rows, None, None, 0, OF_WORDS), ("E", grams[1], spread, grams[0], OF_WORDS, OF_GRAMS)):
        own, inverse = np.unique(of, return_inverse=True)
        inverse = inverse.reshape(-1)
        g[k] = own, np.stack([np.bincount(inverse, dx[:, first + i] if at is None else dx[at, first + i] * share, len(own)) for i in range(size)], axis=1).astype(np.float32)
    return loss, g


def _family(words: list[str], k: int = 6) -> set:
    """Least hashes of a text's word runs; near copies share most."""
    runs = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
    return {(i, int(((runs * np.uint64(2 * i + 3) * np.uint64(0x9E3779B1) + np.uint64(i * 0x7F4A7C15)) & np.uint64(0xFFFFFFFF)).min())) for i in range(k)}


def without_near_copies(rows: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Words and label of the rows that have words, without near copies of one earlier row of the same label."""
    out, holders = [], defaultdict(list)
    same: dict[str, str] = {}  # one string object for each word
    for text, label in rows:
        w = [same.setdefault(x, x) for x in words_of(text)]
        if not w:
            continue
        family = [(int(label), *x) for x in _family(w)]
        shared = Counter(k for x in family for k in holders[x])
        if any(n > len(family) // 2 for n in shared.values()):
            continue
        for x in family:
            holders[x].append(len(out))
        out.append((w, int(label)))
    return out


class Lexicon:
    """The training texts as numbers of their distinct words, and the words' n-grams as numbers."""

    def __init__(self, texts: list[list[str]]):
        words: dict[str, int] = {}
        self.texts = [np.fromiter((words.setdefault(w, len(words)) for w in t), np.int32, len(t)) for t in texts]
        self.words, self.words_in = list(words), [np.unique(t) for t in self.texts]
        # n-grams that fewer texts hold than an embedding needs can't speak for a label, and aren't listed; a table of hashes counts them
        whole = np.fromiter((len(grams_of(w)) for w in self.words), np.int64, len(self.words))
        slots = np.fromiter((zlib.crc32(g.encode()) & (SLOTS - 1) for w in self.words for g in grams_of(w)), np.int32, int(whole.sum()))
        self.sizes, self.starts, self.grams = whole, np.cumsum(whole) - whole, slots
        often = self.held([np.unique(slots[self._places(t)]) for t in self.words_in], range(len(texts)), SLOTS) >= LEAST_TEXTS
        grams: dict[str, int] = {}
        listed = often[slots].tolist()
        every = (g for w in self.words for g in grams_of(w))
        self.grams = np.array([grams.setdefault(g, len(grams)) for g, some in zip(every, listed, strict=True) if some], np.int32)
        self.sizes = np.add.reduceat(np.array(listed, np.int64), self.starts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.share = (whole**-0.5).astype(np.float32)
        self.names = list(grams)
        self.grams_in = [np.unique(self.grams[self._places(t)]) for t in self.words_in]

    def _places(self, words: np.ndarray) -> np.ndarray:
        n = self.sizes[words]
        return np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def held(self, of: list[np.ndarray], which, size: int) -> np.ndarray:
        """How many of the texts `which` hold each word or n-gram."""
        return np.bincount(np.concatenate([of[i] for i in which] or [np.zeros(0, np.int32)]), minlength=size)

    def suspicious_windows(self, labels: np.ndarray, folds: int = 4) -> list[list[int]]:
        """Each text's windows, the most suspicious first, by log odds of words and n-grams in the other folds' texts."""
        out: list = [None] * len(self.texts)
        for f in range(folds):
            others = [i for i in range(len(labels)) if i % folds != f]
            n = [[i for i in others if labels[i] == y] for y in (0, 1)]
            words, grams = (least_log_odds(self.held(of, n[1], size), self.held(of, n[0], size), len(n[1]), len(n[0])) for of, size in ((self.words_in, len(self.words)), (self.grams_in, len(self.names))))
            speaks = words.copy()
            np.maximum.at(speaks, np.repeat(np.arange(len(self.words)), self.sizes), grams[self.grams])
            for i in range(f, len(labels), folds):
                z = speaks[self.texts[i]]
                out[i] = np.argsort([-float(np.sort(z[s : s + WINDOW])[-2:].sum()) for s in windows(len(z))], kind="stable").tolist()
        return out

    def keep(self, least: int) -> tuple[dict[str, int], dict[str, int]]:
        """Rows of V (from 1 on) and of E of the words and n-grams that at least so many texts hold; other n-grams are forgotten."""
        every = range(len(self.texts))
        words, grams = np.flatnonzero(self.held(self.words_in, every, len(self.words)) >= least), np.flatnonzero(self.held(self.grams_in, every, len(self.names)) >= least)
        self.rows, rows = np.zeros(len(self.words), np.int64), np.full(len(self.names), -1)
        self.rows[words], rows[grams] = np.arange(1, len(words) + 1), np.arange(len(grams))
        known = rows[self.grams] >= 0
        self.sizes = np.bincount(np.repeat(np.arange(len(self.words)), self.sizes)[known], minlength=len(self.words))
        self.grams, self.starts = rows[self.grams[known]], np.cumsum(self.sizes) - self.sizes
        return {self.words[w]: i for i, w in enumerate(words.tolist(), 1)}, {self.names[g]: i for i, g in enumerate(grams.tolist())}

    def gather(self, words: np.ndarray, used: np.ndarray):
        """(rows of V, n-grams, their shares) of a (steps, windows) array of words, where used; after keep()."""
        at = np.flatnonzero(used.reshape(-1))
        w = words.reshape(-1)[at]
        n = self.sizes[w]
        return np.where(used, self.rows[words], 0), (np.repeat(at, n), self.grams[self._places(w)]), np.repeat(self.share[w], n)


def least_log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Log odds ratios, ERRORS standard errors below their estimates; 0 where that is no evidence."""
    ratio = np.log((toxic + 0.5) / (all_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (all_clean - clean + 0.5))
    return np.maximum(0, ratio - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def _window(text: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, -1, np.int64)
    part = text[start : start + WINDOW]
    out[: len(part)] = part
    return out


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS, batch: int = 128, seed: int = 2) -> dict | None:
    """The model fitted to (text, label) rows: parameters and the known words; None without both labels.

    The first round reads the most suspicious windows, each later one those that the network itself finds most
    toxic: of a toxic text that one, of a clean text also a random one.
    """
    found = without_near_copies(rows)
    labels = np.array([y for _, y in found])
    if len(set(labels.tolist())) < 2:
        return None
    words = [w for w, _ in found]
    lexicon = Lexicon(words)
    suspicious = lexicon.suspicious_windows(labels)
    inputs = Inputs(*lexicon.keep(max(LEAST_TEXTS, int(LEAST_SHARE * labels.sum()))))
    keep = min(KEEP, max(0.5, labels.sum() / 100))
    rng = np.random.default_rng(seed)
    p = new_parameters(len(inputs.words), len(inputs.grams), seed)
    first, second, step = {k: np.zeros_like(v) for k, v in p.items() if k not in "VE"}, {k: np.zeros_like(v) for k, v in p.items() if k not in "VE"}, 0
    alive = {k: np.zeros(len(p[k]), bool) for k in "VE"}
    for turn in range(rounds):
        chosen, targets, weight = [], [], []
        tops = None if turn == 0 else Scorer({"p": p, "words": inputs.words, "grams": inputs.grams}).tops(words)
        for i, text in enumerate(lexicon.texts):
            starts = windows(len(text))
            if turn == 0:
                own = suspicious[i][:1] if labels[i] else [*suspicious[i][:1], int(rng.integers(len(starts)))]
            else:
                own = [tops[i]] if labels[i] else [tops[i], int(rng.integers(len(starts)))]
            for k in own:
                chosen.append(_window(text, starts[k]))
                targets.append(labels[i])
                weight.append(1 / len(own))
        windowed, targets, weight = np.array(chosen), np.array(targets, np.float32), np.array(weight, np.float32)
        weight[targets > 0] *= min(3.0, weight[targets == 0].sum() / weight[targets > 0].sum())
        epochs = max(EPOCHS, min(40, -(-STEPS * batch // len(targets))))
        for epoch in range(epochs):
            order = rng.permutation(len(targets))
            for at in range(0, len(order), batch):
                b = order[at : at + batch]
                own = windowed[b].T
                used = own >= 0
                rows_of, grams, spread = lexicon.gather(np.maximum(own, 0), used)
                _, g = loss_and_gradients(p, rows_of, grams, spread, used.astype(np.float32)[:, :, None], targets[b], weight[b] / weight[b].sum())
                step += 1
                rate = RATE * min(1.0, step / 20) * 0.5 ** (FALL * (epoch + turn * epochs) / (rounds * epochs))
                shrink = rate * SPEED * keep / len(targets)
                norm = math.sqrt(sum(float((x * x).sum()) for k, x in g.items() if k not in "VE"))
                for k in "VE":
                    own, slope = g.pop(k)
                    p[k][own] -= rate * SPEED * slope
                    alive[k][own] = True
                    at_k = np.flatnonzero(alive[k])
                    size = np.sqrt((p[k][at_k] ** 2).sum(axis=1, keepdims=True))
                    p[k][at_k] *= np.maximum(0, 1 - shrink / np.maximum(size, 1e-9))
                    alive[k][at_k] = size[:, 0] > shrink
                p["V"][0] = 0  # words without a row of their own
                for k in g:
                    d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d * d - second[k])
                    p[k] -= (rate * ((first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6) + DECAY * p[k])).astype(np.float32)
    model = _pruned(p, inputs)
    scorer = Scorer(model)
    highest = np.concatenate([scorer.scores(words[i : i + 200], raw=True) for i in range(0, len(words), 200)])
    p["o"] += math.log(THRESHOLD / (1 - THRESHOLD)) - parting(highest, labels)
    return model


def parting(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the fewest errors, each label counting alike, amid its gap."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order] > 0
    errors = np.concatenate([[0], np.cumsum(y / y.sum())]) + np.concatenate([np.cumsum((~y / (~y).sum())[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    errors[1:-1][z[1:] <= z[:-1]] = np.inf  # no cut between equal logits
    i = int(np.argmin(errors))
    return float(edges[i] + edges[i + 1]) / 2


def _pruned(p: dict, inputs: Inputs) -> dict:
    """The model with the rows that training left different from zero."""
    words = {w: i for w, i in inputs.words.items() if p["V"][i].any()}
    grams = {g: i for g, i in inputs.grams.items() if p["E"][i].any()}
    p = p | {"V": p["V"][[0, *words.values()]], "E": p["E"][list(grams.values())].reshape(-1, OF_GRAMS)}
    return {"p": p, "words": {w: k for k, w in enumerate(words, 1)}, "grams": {g: k for k, g in enumerate(grams)}}


class Scorer:
    """Scores texts with a trained model."""

    def __init__(self, model: dict | None):
        self.model = model
        self.rows: dict[str, int] = {}
        if model:
            p = self.p = model["p"]
            self.inputs = Inputs(model["words"], model["grams"])
            self.w = np.concatenate([p["Wf"], p["Wb"]], axis=1)
            self.c = np.concatenate([p["cf"], p["cb"]])
            self.table = np.empty((0, 6 * HIDDEN), np.float32)

    def _learn(self, new: list[str]) -> None:
        found = [self.inputs(word) for word in new]
        x = np.zeros((len(new), OF_WORDS + OF_GRAMS), np.float32)
        x[:, :OF_WORDS] = self.p["V"][[v for v, _, _ in found]]
        for k, (_, grams, share) in enumerate(found):
            if grams:
                x[k, OF_WORDS:] = self.p["E"][grams].sum(axis=0) * share
        at = len(self.rows)
        if not len(self.table):  # pages are touched as they are filled
            self.table = np.empty((CACHE_WORDS + AT_ONCE, 6 * HIDDEN), np.float32)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:at], np.empty((len(new), 6 * HIDDEN), np.float32)])
        self.table[at : at + len(new)] = x @ self.w + self.c
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def _windows(self, texts: list[list[str]]):
        """(text, logit) of all windows, in order."""
        every = set().union(*texts) if texts else set()
        if len(every) + len(self.rows) > CACHE_WORDS:
            self.rows = {}
        if new := sorted(every.difference(self.rows)):
            self._learn(new)
        index, owner, lengths = [], [], []
        for i, w in enumerate(texts):
            if w:
                own = np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w))
                starts = np.array(windows(len(w)))
                steps = starts[:, None] + np.arange(WINDOW)
                index.append(own[np.minimum(steps, len(w) - 1)])
                owner.append(np.full(len(starts), i))
                lengths.append(np.full(len(starts), min(len(w), WINDOW)))
        if not index:
            return
        index, owner, lengths = np.concatenate(index), np.concatenate(owner), np.concatenate(lengths)
        for at in range(0, len(index), 2048):
            k = slice(at, at + 2048)
            x = self.table[np.ascontiguousarray(index[k].T)]
            mask = (np.arange(WINDOW)[:, None] < lengths[k][None, :]).astype(np.float32)[:, :, None]
            yield owner[k], forward(self.p, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask)

    def scores(self, texts: list[list[str]], raw: bool = False) -> np.ndarray:
        """Scores of texts given as words: that of the highest window."""
        out = np.full(len(texts), -np.inf)
        if self.model:
            for owner, logit in self._windows(texts):
                np.maximum.at(out, owner, logit)
        return out if raw else sigmoid(out)

    def tops(self, texts: list[list[str]], at_once: int = 200) -> list[int]:
        """The number of each text's highest window."""
        out = []
        for i in range(0, len(texts), at_once):
            own = texts[i : i + at_once]
            found = list(self._windows(own))
            owner, logit = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
            order = np.lexsort((-logit, owner))
            begins = np.searchsorted(owner, np.arange(len(own)))
            out += (order[begins] - begins).tolist()
        return out


def training_rows(docs: DataFrame, labels: DataFrame, held_out, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts that aren't held out, in the order of their hashed ids."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id"))
    picked = []
    for label, most in ((1, most_toxic), (0, most_clean)):
        picked += known.where((F.col("toxic") > 0) == F.lit(bool(label))).orderBy("draw", "doc_id").limit(most).collect()  # at most `most` rows
    if not picked:
        return []
    sample = small_table(spark, {"doc_id": ("int64", [r["doc_id"] for r in picked]), "toxic": ("int32", [int(r["toxic"] > 0) for r in picked]), "draw": ("int64", [r["draw"] for r in picked])})
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")
    found = texts.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text")).collect()  # at most most_toxic + most_clean rows
    return [(r["text"], r["toxic"]) for r in sorted(found, key=lambda r: (r["draw"], r["doc_id"]))]


def third_held_out(doc_id):
    """Rows whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, with toxic_score and is_toxic."""
    return _with_scores(docs, model, threshold, docs.columns)


def _with_scores(docs: DataFrame, model: dict | None, threshold: float, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by the training sample
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("toxic_score", T.DoubleType()), T.StructField("is_toxic", T.IntegerType())])
    names = [f.name for f in schema.fields]
    text_at = keep.index("text")

    def run(batches):
        import pyarrow as pa

        worker_cache("toxicity", int)  # only so that memory is given back at the end
        scorer = Scorer(shared.value)
        for b in batches:
            scores, waiting, held = [], [], 0
            for t in b.column(text_at):
                w = words_of(t.as_py())
                waiting.append(w)
                held += len(w)
                if held >= AT_ONCE:
                    scores.append(scorer.scores(waiting))
                    waiting, held = [], 0
            scores.append(scorer.scores(waiting))
            s = np.round(np.concatenate(scores), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=names)

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(forgetting(run), schema)


def without_toxic(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}" if c != "text" else c) for i, c in enumerate(docs.columns)))
    kept = _with_scores(inner, model, threshold, inner.columns).where("is_toxic = 0")
    return kept.select(*(F.col(a).alias(c) for a, c in zip(inner.columns, docs.columns, strict=True)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model of the labelled rows that aren't held out."""
    model = train(training_rows(docs, labels, third_held_out))
    scored = _with_scores(docs.select("doc_id", "text"), model, threshold, ["doc_id", "text"])
    return scored.select("doc_id", third_held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("is_toxic").alias("predicted"))
