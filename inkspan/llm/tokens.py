"""Token ids of whole texts, with the tokenizers library doing all encoding.

The vocabulary word_bpe_49k normalises character by character, lower-cases,
splits at white space and never joins a letter or digit with a mark after it.
So a text's ids are those of its white-space-separated chunks one after the
other, and those of a chunk that ends in ASCII marks after a letter or digit
are its stem's and then the marks'.  Each distinct chunk is encoded once by the
library and remembered.  A vocabulary with other rules, and a text with a
special token's opening, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

from inkspan.llm.common import worker_cache

#: Chunks remembered in a worker, in two generations; those used of late stay.
CACHE_CHUNKS = 700_000
#: What a vocabulary file must say for its texts to be encoded chunk by chunk.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters of ASCII and Latin-1, which are their own NFC form and have a lower case of one letter.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: How byte-level vocabularies show bytes: printable ones as themselves, the others from code point 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_MARKS = b".,!?*$#&%;:()|"
_BEFORE_MARKS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _by_chunk(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normalizers = (rules.get("normalizer") or {}).get("normalizers", [])
    splitters = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splitters[0].get("pattern", {}).get("Regex") if splitters else None
    special = all(t["content"].startswith("<|") for t in rules.get("added_tokens", []))
    return [x["type"] for x in normalizers] == NORMALIZERS and pattern == SPLITTER and special


class _Chunks(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit bytes, encoded when first asked for."""

    def __init__(self, tokenizer, old: dict):
        self.whole, self.word, self.old = tokenizer.encode, tokenizer.model.tokenize, old

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            stem = chunk.rstrip(_MARKS)
            n = len(stem)
            if 0 < n < len(chunk) and stem[-1] in _BEFORE_MARKS:
                ids = self[stem] + self[chunk[n:]]
            elif chunk.isalpha() if chunk.isascii() else _LETTERS.fullmatch(chunk):  # letters without marks are one word, so the model alone is enough
                shown = chunk.decode() if chunk.isascii() else chunk.decode().lower().encode().decode("latin-1").translate(_SHOWN_BYTES)
                found = [t.id for t in self.word(shown)]
                ids = pack(f"<{len(found)}I", *found)
            else:
                ids = np.array(self.whole(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = _by_chunk(path)
        self.generation = cache_chunks // 2
        self.known = _Chunks(self.tokenizer, {})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > self.generation:
            self.known.old = {}
            self.known = _Chunks(self.tokenizer, self.known)
        return b"".join(map(self.known.__getitem__, text.encode("utf-8").lower().split()))


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encoder(path: str) -> ChunkEncoder:
    worker_cache("tokens", _encoder.cache_clear)
    return _encoder(path)
