"""One text read in Python: words, sentences, paragraphs, measurements and inventories.

Spark's functions of arrays are interpreted element by element and each of them reads the text again; here a text is cut
into words once, and all that is asked for is made of them.  The rules are those of functions/text.py.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from itertools import chain, islice

from inkspan.functions import lexicon as lx

#: lx.WORD in Python's classes: \w without digits and underscore is L, Nl and No, and \d is Nd.
_found_words = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+(?:\.\d+)?").findall
#: All but letters is space; digits and apostrophes, whose place matters, are marked.
_SPACED = {i: c if (c := chr(i)).isalpha() else "\0" if c.isdigit() or c == "'" else " " for i in range(128)}
_ENDS = re.compile(r"([.!?…])[.!?…]*\s+(?=[\"'“”‘’(\[]*[A-Z0-9])")
_DOTTED = r"[A-Za-z](?:\.[A-Za-z.]{0,3}|[A-Za-z.]\.[A-Za-z.]{0,2}|[A-Za-z.]{2}\.[A-Za-z.]?|[A-Za-z.]{3}\.)[A-Za-z]"
_abbreviated = re.compile(rf"(?:^|[^A-Za-z.])\.{{0,24}}(?:(?i:{'|'.join(a.replace('.', r'\.') for a in lx.ABBREVIATIONS)})|{_DOTTED})\Z").search
#: More than what _abbreviated can match, so that the window's own start is never taken for the text's.
_BACK = 32
_BLANK_LINES = re.compile(r"\n\s*\n")
_SHORT = {a for a in lx.ABBREVIATIONS if "." not in a}
_not_letters = re.compile("[^a-z]+").sub
_CONNECTIVES = [(c, c.split(" ")[0], f" {c} ") for c in lx.CONNECTIVES]
_PRONOUNS = {p: i for i, p in enumerate(lx.PRONOUNS)}
#: The syllables of words that this worker has met, by pattern of vowels; emptied when full.
_SYLLABLES: dict[str, dict[str, int]] = {}
_MOST_WORDS = 100_000


def lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def nfkc(text: str) -> str:
    return lines(text if text.isascii() else unicodedata.normalize("NFKC", text))


def words(text: str) -> list[str]:
    if text.isascii():
        spaced = text.translate(_SPACED)
        if "\0" not in spaced:
            return spaced.split()
    return _found_words(text)


def _is_abbreviated(text: str, at: int) -> bool:
    """Whether an abbreviation ends before a place; the pattern is for what isn't a plain word after a space."""
    near = text[max(0, at - 7) : at]  # no abbreviation is longer than six
    i = near.rfind(" ")
    word = near[i + 1 :]
    if word.isascii() and word.isalpha():
        if i >= 0:
            return word.lower() in _SHORT
        if len(word) == 7:
            return False
    return _abbreviated(text[max(0, at - _BACK) : at]) is not None


def sentences(text: str) -> list[str]:
    """The text cut after each sentence's end."""
    out, start = [], 0
    for found in _ENDS.finditer(text):
        at = found.start()
        if found[1] != "." or not _is_abbreviated(text, at):
            out.append(text[start : found.end()])
            start = found.end()
    out.append(text[start:])
    return [s for piece in out for s in piece.split("\x01")] if "\x01" in text else out


def count_syllables(word: str, vowels) -> int:
    """Of a word in lower case; vowels finds its groups of vowels."""
    w = word if word.isascii() and word.isalpha() else _not_letters("", word.lower())
    if len(w) <= 3:
        return int(w != "")
    stem = w[:-1] if w.endswith("e") and not w.endswith("le") else w
    groups = len(vowels(stem))
    return max(groups - 1 if groups > 1 and w.endswith(("es", "ed")) else groups, 1)


def most_frequent(counts: dict, k: int) -> list[tuple]:
    """The k largest counts with their items; ties go to the item that came first."""
    often = sorted((x for x in counts.items() if x[1] > 1), key=lambda x: -x[1])
    if len(often) < k:
        often += islice((x for x in counts.items() if x[1] == 1), k - len(often))
    return often[:k]


def median(ordered: list) -> float | None:
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2.0 if n else None


def mean(values: list) -> float | None:
    return sum(values) / len(values) if values else None


def deviation(values: list) -> float | None:
    if not values:
        return None
    m, total = sum(values) / len(values), 0.0
    for x in values:
        total += (x - m) * (x - m)
    return math.sqrt(total / len(values))


class Reading:
    """What is found in a text, each part when it is first asked for."""

    def __init__(self, raw: str, clean: str, vowels: str | None = None):
        self.raw, self.clean, self.vowels = raw, clean, vowels

    @cached_property
    def _by_sentence(self) -> list[list[str]]:
        return [w for s in sentences(self.clean) if (w := words(s))]

    @cached_property
    def words(self) -> list[str]:
        if "_by_sentence" in self.__dict__:
            return list(chain.from_iterable(self._by_sentence))
        return words(self.clean)

    @cached_property
    def n(self) -> int:
        return len(self.words)

    @cached_property
    def lengths(self) -> list[int]:
        return [len(s) for s in self._by_sentence]

    @cached_property
    def ordered_lengths(self) -> list[int]:
        return sorted(self.lengths)

    @cached_property
    def paragraphs(self) -> list[tuple[int, int]]:
        """(words, sentences) of each paragraph."""
        parts = [p for p in _BLANK_LINES.split(self.clean) if p and not p.isspace()]
        if len(parts) == 1:  # the text itself, but for space around it
            return [(sum(self.lengths), len(self.lengths))]
        found = [[len(w) for s in sentences(p) if (w := words(s))] for p in parts]
        return [(sum(x), len(x)) for x in found]

    @cached_property
    def para_words(self) -> list[int]:
        return [w for w, _ in self.paragraphs]

    @cached_property
    def para_sentences(self) -> list[int]:
        return [s for _, s in self.paragraphs]

    @cached_property
    def joined(self) -> str:
        return " ".join(self.words).lower()  # no word holds a space

    @cached_property
    def low(self) -> list[str]:
        return self.joined.split(" ") if self.words else []

    @cached_property
    def counts(self) -> Counter:
        return Counter(self.low)

    @cached_property
    def chars(self) -> int:
        return len("".join(self.words))

    @cached_property
    def low_chars(self) -> list[int]:
        return list(map(len, self.low))

    @cached_property
    def ordered_low_chars(self) -> list[int]:
        return sorted(self.low_chars)

    @cached_property
    def syllables(self) -> tuple[int, int]:
        """Syllables, and words with three or more of them."""
        known, vowels = _SYLLABLES.setdefault(self.vowels, {}), re.compile(self.vowels).findall
        if len(known) > _MOST_WORDS:
            known.clear()
        total = complex_words = 0
        for word, times in self.counts.items():
            if (s := known.get(word)) is None:
                s = known[word] = count_syllables(word, vowels)
            total += s * times
            if s >= 3:
                complex_words += times
        return total, complex_words

    @cached_property
    def readable(self) -> bool:
        return self.n > 0 and len(self.lengths) > 0

    @cached_property
    def connectives(self) -> list[tuple[str, int]]:
        joined, known = f" {self.joined} ", self.counts
        return [(c, times) for c, first, within in _CONNECTIVES if first in known and (times := joined.count(within))]

    @cached_property
    def pronouns(self) -> list[tuple[str, int]]:
        """In the order of the list."""
        return sorted(((w, n) for w, n in self.counts.items() if w in _PRONOUNS), key=lambda x: _PRONOUNS[x[0]])

    def ngrams(self, n: int) -> dict:
        return self.counts if n == 1 else Counter(zip(*(islice(self.low, i, None) for i in range(n)), strict=False))

    def top_ngrams(self, n: int, k: int) -> list[tuple[str, int]]:
        found = most_frequent(self.ngrams(n), k)
        return found if n == 1 else [(" ".join(x), times) for x, times in found]

    def repeated(self, least: int) -> list[tuple[str, int]]:
        """The words that come at least so often: the most frequent first, then by name."""
        return sorted((x for x in self.counts.items() if x[1] >= least), key=lambda x: (-x[1], x[0]))

    def top_characters(self, n: int, k: int) -> list[tuple[str, int]]:
        """Of the raw text, in lower case and with single spaces."""
        s = " ".join(lines(self.raw).lower().split())
        return most_frequent(Counter([s[i : i + n] for i in range(len(s) - n + 1)]), k)

    def mark(self, i: int) -> int:
        m = lx.MARKS[i]
        return self.raw.count(m) + (sum(map(self.raw.count, lx.CURLY_QUOTES)) if m == '"' else 0)


def _ratio(a, b):
    return a / b if b > 0 else None


def _share(test):
    return lambda r: _ratio(sum(map(test, r.lengths)), len(r.lengths))


def _readable(value):
    return lambda r: value(r, r.n, len(r.lengths)) if r.readable else None


def _variation(r: Reading) -> float | None:
    m = mean(r.lengths)
    return deviation(r.lengths) / m if m else None


#: Measurement (unrounded) of a Reading.
MEASURES = {
    "characters": lambda r: len(r.raw),
    "characters_no_spaces": lambda r: len("".join(r.raw.split())),
    "words": lambda r: r.n,
    "sentences": lambda r: len(r.lengths),
    "paragraphs": lambda r: len(r.paragraphs),
    "average_word_length": lambda r: _ratio(r.chars, r.n),
    "average_sentence_length": lambda r: mean(r.lengths),
    "median_sentence_length": lambda r: median(r.ordered_lengths),
    "min_sentence_length": lambda r: min(r.lengths, default=None),
    "max_sentence_length": lambda r: max(r.lengths, default=None),
    "sentence_deviation": lambda r: deviation(r.lengths),
    "sentence_variation": _variation,
    "short_ratio": _share(lambda x: x <= lx.SHORT_MAX),
    "medium_ratio": _share(lambda x: lx.SHORT_MAX < x <= lx.MEDIUM_MAX),
    "long_ratio": _share(lambda x: x > lx.MEDIUM_MAX),
    "average_words_per_paragraph": lambda r: mean(r.para_words),
    "median_words_per_paragraph": lambda r: median(sorted(r.para_words)),
    "min_words_per_paragraph": lambda r: min(r.para_words, default=None),
    "max_words_per_paragraph": lambda r: max(r.para_words, default=None),
    "paragraph_deviation": lambda r: deviation(r.para_words),
    "average_sentences_per_paragraph": lambda r: mean(r.para_sentences),
    "median_sentences_per_paragraph": lambda r: median(sorted(r.para_sentences)),
    "min_sentences_per_paragraph": lambda r: min(r.para_sentences, default=None),
    "max_sentences_per_paragraph": lambda r: max(r.para_sentences, default=None),
    "unique_words": lambda r: len(r.counts),
    "type_token_ratio": lambda r: _ratio(len(r.counts), r.n),
    "guiraud_r": lambda r: len(r.counts) / math.sqrt(r.n) if r.n else None,
    "vocabulary_word_length": lambda r: mean(r.low_chars),
    "median_word_length": lambda r: median(r.ordered_low_chars),
    "min_word_length": lambda r: min(r.low_chars, default=None),
    "max_word_length": lambda r: max(r.low_chars, default=None),
    "word_length_deviation": lambda r: deviation(r.low_chars),
    "syllables": lambda r: r.syllables[0],
    "complex_words": lambda r: r.syllables[1],
    "flesch_reading_ease": _readable(lambda r, n, s: 206.835 - 1.015 * (n / s) - 84.6 * (r.syllables[0] / n)),
    "flesch_kincaid_grade": _readable(lambda r, n, s: 0.39 * (n / s) + 11.8 * (r.syllables[0] / n) - 15.59),
    "gunning_fog": _readable(lambda r, n, s: 0.4 * (n / s + 100 * r.syllables[1] / n)),
    "coleman_liau": _readable(lambda r, n, s: 0.0588 * (r.chars / n * 100) - 0.296 * (s / n * 100) - 15.8),
    "automated_readability_index": _readable(lambda r, n, s: 4.71 * (r.chars / n) + 0.5 * (n / s) - 21.43),
    "pronoun_count": lambda r: sum(n for _, n in r.pronouns),
    "transition_count": lambda r: sum(n for _, n in r.connectives),
    **{f"mark_{i}": lambda r, i=i: r.mark(i) for i in range(len(lx.MARKS))},
}
#: Of these only the raw text is read.
OF_RAW = {"characters", "characters_no_spaces", *(f"mark_{i}" for i in range(len(lx.MARKS)))}
OF_SYLLABLES = {"syllables", "complex_words", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"}
OF_SENTENCES = {n for n in MEASURES if "sentence" in n or "paragraph" in n or n.endswith("_ratio") and n != "type_token_ratio"} | {"flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau", "automated_readability_index"}
#: Inventory of a Reading with its parameters: pairs (item, count).
INVENTORIES = {
    "ngrams": Reading.top_ngrams,
    "repeated": Reading.repeated,
    "characters": Reading.top_characters,
    "connectives": lambda r: r.connectives,
    "pronouns": lambda r: r.pronouns,
}


def read(texts: Iterable[str], measures: list[str], inventories: list[tuple], normalize: bool = True, vowels: str | None = None) -> tuple[list[list], list[list]]:
    """A column for each measurement and each inventory (name, *parameters) of the texts."""
    wants_clean = bool(set(measures) - OF_RAW) or any(x[0] != "characters" for x in inventories)
    by_sentence = bool(OF_SENTENCES & set(measures))
    uses = [MEASURES[m] for m in measures]
    made = [(INVENTORIES[name], parameters) for name, *parameters in inventories]
    columns, lists = [[] for _ in uses], [[] for _ in made]
    collects = gc.isenabled()
    gc.disable()  # nothing here refers to itself, and the many short-lived pairs would be looked through again and again
    try:
        _read(texts, wants_clean, by_sentence, normalize, vowels, uses, made, columns, lists)
    finally:
        if collects:
            gc.enable()
    return columns, lists


def _read(texts, wants_clean, by_sentence, normalize, vowels, uses, made, columns, lists) -> None:
    for text in texts:
        r = Reading(text, (nfkc(text) if normalize else lines(text)) if wants_clean else "", vowels)
        if by_sentence:
            r._by_sentence  # first, so that the words are found once
        for column, use in zip(columns, uses, strict=True):
            column.append(use(r))
        for column, (use, parameters) in zip(lists, made, strict=True):
            column.append(use(r, *parameters))
