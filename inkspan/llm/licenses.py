"""License scans by conditional compression.

A text is read as words, so line breaks, comment marks and punctuation don't
matter.  A template of n words may differ by d = n x DIFFERENCES words; of any
d + 1 disjoint runs of its words a fitting stretch has one unchanged, so these
runs find all windows where the template can stand.  In a window an alignment
of words gives the candidate block: the stretch with the fewest words lacking
and beyond, whether they are few enough or not.  Each candidate block is
compressed alone and with every template as zstandard raw dictionary; the share
of its size that a template saves ranks the templates.  They are confirmed in
that order by their exact differences in wording; of the first that fits and
those that save less by under MARGIN, the one with the fewest differences names
the block.  Blocks that overlap are ranked by their saving, in steps of MARGIN,
then by differences, then by length.  A winner grows to the longest fitting
stretch of the same license around it.

Templates are notices, paragraphs and tags of public licenses; a caller can
give others.  `...` in a template stands for up to GAP_WORDS words (holders,
years).

Edge cases: a null or empty text gives no rows;
repeated rows and null doc_ids are scanned like others; a stretch that
occurs more than once is reported each time; ties go to the template that comes
first; an empty table gives no rows; only doc_id and text
are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, OrderedDict
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Wordings of public licenses.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright ... All rights reserved."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
]
#: Names that follow "under the", and identifiers that follow the tag.
NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License, Version 2"), ("Apache-2.0", "Apache 2.0 License"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-2.0", "GNU General Public License, version 2"), ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("AGPL-3.0", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"), ("Zlib", "zlib License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("EPL-2.0", "Eclipse Public License 2.0"),
]
TEMPLATES += [(i, f"under the {name}") for i, name in NAMES]
TEMPLATES += [(i, f"SPDX-License-Identifier: {i}") for i in dict.fromkeys(i for i, _ in TEMPLATES) if i != "all-rights-reserved"]
#: Differing words allowed for each word of the template.
DIFFERENCES = 0.1
#: Templates and blocks whose savings differ by less are one rank.
MARGIN = 0.1
#: Words that `...` in a template stands for at most.
GAP_WORDS = 30
#: Alignments that a worker remembers, and as many rankings.
CACHE_WINDOWS = 20_000

_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
_TEMPLATE_WORD = re.compile(rf"{_WORD.pattern}|\.\.\.")
_MARKS = re.compile(r"[^\w\s]*")


def wording(template: str) -> list[str]:
    return _TEMPLATE_WORD.findall(template.lower())


def pieces(template: list[str], allowed: int) -> list[tuple[int, list[str]]]:
    """allowed + 1 disjoint runs of the template's words, the longest ones, with their places; none has `...`."""
    segments, at = [], 0
    for k, w in enumerate([*template, "..."]):
        if w == "...":
            if k > at:
                segments.append((at, k))
            at = k + 1
    whole = sum(z - a for a, z in segments)
    out = []
    for a, z in segments:
        n = min(z - a, -(-(allowed + 1) * (z - a) // whole))
        cuts = [a + (z - a) * i // n for i in range(n + 1)]
        out += [(x, template[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return sorted(out, key=lambda x: -len(x[1]))[: allowed + 1]


def align(template: list[str], words: list[str], whole: bool = False) -> tuple[int, int, list[str], list[str]]:
    """First and end of the words that fit the template best (all of them if whole), what they lack and have beyond."""
    rows, steps = [[(0, -j) if not whole else (j, 0) for j in range(len(words) + 1)]], []
    for t in template:
        up = rows[-1]
        free = t == "..."
        row, step = [(up[0][0] + (not free), up[0][1])], ["l"]
        for j, w in enumerate(words):
            options = [((up[j + 1][0] + (not free), up[j + 1][1]), "l"), ((row[j][0] + (not free), row[j][1]), "b")]
            if w == t:
                options.append((up[j], "e"))
            best = min(options)
            row.append(best[0])
            step.append(best[1])
        rows.append(row)
        steps.append(step)
    last = rows[-1]
    j = end = len(words) if whole else min(range(len(last)), key=lambda x: (last[x][0], x + last[x][1], x))
    first, i, lacks, beyond = -last[end][1], len(template), [], []
    while i or j > first:
        kind = steps[i - 1][j] if i else "b"
        if kind == "b":
            j -= 1
            if not i or template[i - 1] != "...":
                beyond.append(words[j])
            continue
        i -= 1
        if kind == "e":
            j -= 1
        elif template[i] != "...":
            lacks.append(template[i])
    return first, end, lacks[::-1], beyond[::-1]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words that it has beyond; `...` takes any."""
    return align(template, block, whole=True)[2:]


def least_differences(template: Counter, block: Counter) -> int:
    """Words that differ in any order; never more than differences() has."""
    return sum((template - block).values()) - template["..."] + (0 if template["..."] else sum((block - template).values()))


class Matcher:
    def __init__(self, templates=None, differences_allowed: float = DIFFERENCES):
        import zstandard

        self.templates = [(i, t, wording(t)) for i, t in templates or TEMPLATES]
        self.allowed = [int(differences_allowed * len(w) + 1e-9) for _, _, w in self.templates]
        self.counts = [Counter(w) for _, _, w in self.templates]
        self.pieces: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, _, w) in enumerate(self.templates):
            for at, run in pieces(w, self.allowed[k]):
                self.pieces.setdefault(f" {' '.join(run)} ", []).append((k, at, len(run)))
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.with_template = [
            zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, _, w in self.templates
        ]
        self.known: OrderedDict[tuple, tuple[int, int]] = OrderedDict()
        self.named: OrderedDict[tuple, tuple | None] = OrderedDict()

    def savings(self, words: list[str]) -> list[float]:
        """For each template, the share of the block's compressed size that it saves."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        return [1 - len(c.compress(data)) / alone for c in self.with_template]

    def saving(self, k: int, words: list[str]) -> float:
        data = " ".join(words).encode()
        return 1 - len(self.with_template[k].compress(data)) / len(self.plain.compress(data))

    def _stretch(self, k: int, words: list[str]) -> tuple[int, int]:
        """First and end of align(), remembered."""
        key = (k, *words)
        if key in self.known:
            self.known.move_to_end(key)
            return self.known[key]
        out = self.known[key] = align(self.templates[k][2], words)[:2]
        if len(self.known) > CACHE_WINDOWS:
            self.known.popitem(last=False)
        return out

    def name(self, block: list[str]) -> tuple | None:
        """(template, saving, lacks, beyond) of a block, None if no template fits; remembered."""
        key = tuple(block)
        if key in self.named:
            self.named.move_to_end(key)
            return self.named[key]
        saved, counts, best = self.savings(block), Counter(block), []
        for k in sorted(range(len(saved)), key=lambda k: (-saved[k], k)):
            if best and saved[k] <= saved[best[0][2]] - MARGIN:
                break
            if least_differences(self.counts[k], counts) <= self.allowed[k]:
                lacks, beyond = differences(self.templates[k][2], block)
                if len(lacks) + len(beyond) <= self.allowed[k]:
                    best.append((len(lacks) + len(beyond), -saved[k], k, lacks, beyond))
        out = None
        if best:
            _, saving, k, lacks, beyond = min(best, key=lambda x: x[:3])
            out = k, -saving, lacks, beyond
        self.named[key] = out
        if len(self.named) > CACHE_WINDOWS:
            self.named.popitem(last=False)
        return out

    def fits(self, joined: str) -> list[tuple]:
        """(first word, end word, template, saving, lacks, beyond) of all candidate blocks that a template fits; joined has a space around each word."""
        hits = [(piece, places) for piece, places in self.pieces.items() if piece in joined]
        if not hits:
            return []
        words = joined.split()
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        blocks: set[tuple[int, int]] = set()
        for piece, places in hits:
            at = joined.find(piece)
            while at >= 0:
                p = bisect_right(starts, at) - 1
                for k, offset, n in places:
                    template, d = self.templates[k][2], self.allowed[k]
                    if not d and n == len(template):
                        low, window = p, words[p : p + n]
                    else:
                        before, after = template[:offset], template[offset + n :]
                        low = max(0, p - len(before) - d - GAP_WORDS * before.count("..."))
                        window = words[low : p + n + len(after) + d + GAP_WORDS * after.count("...")]
                    first, end = self._stretch(k, window)
                    blocks.add((low + first, low + end))
                at = joined.find(piece, at + 1)
        return [(a, z, *named) for a, z in sorted(blocks) if z > a and (named := self.name(words[a:z]))]

    def scan(self, text: str | None) -> list[tuple]:
        """(first, end, license, template, saving, lacks, beyond) of every stretch with a license."""
        if not text:
            return []
        fits = self.fits(f" {' '.join(_WORD.findall(text))} ".lower())
        if not fits:
            return []
        # overlaps are looked up word by word, so many notices in one text don't cost pairs
        taken: dict[int, int] = {}
        chosen: list[tuple | None] = []
        for f in sorted(fits, key=lambda f: (int((1 - f[3]) / MARGIN), len(f[4]) + len(f[5]), f[0] - f[1], -f[3], f[2], f[0])):
            if not any(x in taken for x in range(f[0], f[1])):
                taken |= dict.fromkeys(range(f[0], f[1]), len(chosen))
                chosen.append(f)
        for f in sorted(fits, key=lambda f: (f[0] - f[1], f[0])):
            over = {taken[x] for x in range(f[0], f[1]) if x in taken}
            if len(over) == 1:
                (i,) = over
                c = chosen[i]
                if f[0] <= c[0] and c[1] <= f[1] and f[1] - f[0] > c[1] - c[0] and self.templates[f[2]][0] == self.templates[c[2]][0]:
                    taken |= dict.fromkeys(range(f[0], f[1]), i)
                    chosen[i] = f
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(spans[a][0], _MARKS.match(text, spans[z - 1][1]).end(), self.templates[k][0], k, round(saving, 6), lacks, beyond) for a, z, k, saving, lacks, beyond in sorted(chosen, key=lambda c: c[0])]


def scan_licenses(docs: DataFrame, templates=None, differences_allowed: float = DIFFERENCES) -> DataFrame:
    """A row for every license notice of every document."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()),
        T.StructField("saving", T.DoubleType()), T.StructField("lacks", T.ArrayType(T.StringType())), T.StructField("beyond", T.ArrayType(T.StringType())), T.StructField("block", T.StringType()),
    ])

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(templates, differences_allowed)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                for found in matcher.scan(text):
                    at.append(i)
                    rows.append((*found, text[found[0] : found[1]]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[f.name for f in schema.fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
