"""License scans by patience alignment.

A template and a text are word sequences. Words that occur once in both are anchors; the longest
increasing subsequence of their places is kept, and the gaps between anchors are aligned the same
way, down to gaps without anchors, whose equal ends are matched. Coverage is the share of the
template's words that are matched.

A text may state a license twice, which would leave no word unique. So templates are aligned with
windows of the text. First every verbatim copy is claimed: a text's grams of ``SEED`` words are
looked up among the beginnings of all templates and compared on from there. Then the stretches
between are searched for altered copies. A template of under ``NOTICE`` words is aligned with a
window around each place of its rarest words, as long as the template on either side; a longer one
with windows of ``WIDTHS`` times its length that start an even share of it apart, so every copy lies
whole in one that is little longer. Windows that share too few of the template's words to reach
the threshold are passed over by counts that slide along; that bound loses nothing. The time is in
proportion to the text. Whole texts are read, in one narrow pass without a shuffle.

Defined results: a null or empty text, or one that no template covers, has a null license and
coverage 0 and no notices; all notices of a text are listed, of overlapping ones that with most
matched words, then of higher coverage, then the smaller name; the license is that of the notice with
most matched words, then the first; repeated rows are scanned each on their own; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table, utf8_column

COVERAGE = 0.8

# Public license notices.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "All rights reserved line": "All rights reserved.",
    "BSD line": "Released under the BSD License.",
    "BSD-2-Clause line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "ISC line": "Released under the ISC License.",
    "MPL-2.0 line": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.0 line": "This work is licensed under the GNU Library General Public License, version 2.",
    "LGPL-2.1 line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0 short line": "Licensed under CC BY 4.0.",
    **{f"CC-{c}-4.0 line": f"Licensed under CC {c} 4.0." for c in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    **{
        f"CC-{c}-4.0 long line": f"This work is licensed under a Creative Commons Attribution-{n} 4.0 International License."
        for c, n in (("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC", "NonCommercial"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives"))
    },
    "CC0-1.0 line": "Licensed under CC0 1.0 Universal.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": _BSD[0] + _BSD[2],
    "BSD-3-Clause": _BSD[0] + _BSD[1] + _BSD[2],
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

TEMPLATES["MIT text"] = TEMPLATES["MIT"] + (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
# Everyday forms of the same notices, and names of the SPDX list.
_SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 BSL-1.0 EPL-1.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
TEMPLATES |= {f"{x} SPDX line": f"SPDX-License-Identifier: {x}" for x in _SPDX}
TEMPLATES |= {
    "MIT terms line": "This project is licensed under the terms of the MIT license.",
    "MIT option line": "or MIT license at your option",
    "Apache-2.0 option line": "Apache License, Version 2.0 or",
    "GPL-3.0 v line": "Released under the GNU General Public License v3.0.",
    "GPL-2.0 v line": "Released under the GNU General Public License v2.0.",
    "BSL-1.0 line": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-1.0 line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0 line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense line": "Released under the Unlicense.",
}
# Full texts, word for word.
TEMPLATES |= {f"{f.stem} text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

#: Words that tell licenses apart. A template of under NOTICE words holds only if its own ones (and
#: its numbers) are all matched and none of the others stands between its matched words.
NAMES = frozenset(b"mit apache gnu gpl lgpl agpl lesser affero bsd isc mozilla mpl eclipse artistic boost cc cc0 by nc sa nd creative commons attribution sharealike share alike noncommercial noderivatives noderivs all rights reserved universal clause bsl epl unlicense v1 v2 v3".split())
NOTICE = 150
#: Words of a template's beginning by which copies are found, and templates below which no word may be inserted.
SEED, WHOLE = 5, 6
#: (width, step) of the windows of long templates, in eighths of their length.
WIDTHS = ((10, 1), (16, 4))

_TO_SPACE = bytes.maketrans(b".,;:()\"'/-!?", b" " * 12)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        if k:
            before[i] = ends[k - 1]
        tops[k : k + 1] = [x]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), ascending."""
    matched, spans = [], [(0, len(a), 0, len(b))]
    while spans:
        a0, a1, b0, b1 = spans.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at]
        kept = [anchors[i] for i in increasing([y for _, y in anchors])]
        matched += kept
        if kept:
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            spans += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(matched)


def dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of matched places with most matches, each word of the text between them counting a
    quarter against it: without stray words far before and after a copy."""
    best, score, start, kept = 0.0, 0.0, 0, (0, 0)
    for i, (_, at) in enumerate(pairs):
        score = score - (at - pairs[i - 1][1] - 1) / 4 if i else 0.0
        if score <= 0:
            score, start = 0.0, i
        score += 1
        if score > best:
            best, kept = score, (start, i + 1)
    return pairs[kept[0] : kept[1]]


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = COVERAGE):
        self.threshold = threshold
        self.templates = [(name, words_of(t.encode())) for name, t in templates.items()]
        self.counts = [Counter(t) for _, t in self.templates]
        self.deciding = [frozenset(w for w in c if w in NAMES or w.isdigit()) if len(t) < NOTICE else frozenset() for (_, t), c in zip(self.templates, self.counts, strict=True)]
        # prose puts these between the words of a notice; only in the short CC names do they decide
        prose = frozenset(b"by all rights reserved share alike creative commons universal clause".split())
        self.strange = [NAMES - c.keys() - (prose if b"cc" not in c else frozenset()) if len(t) < NOTICE else frozenset() for (_, t), c in zip(self.templates, self.counts, strict=True)]
        self.vocabulary = frozenset(w for c in self.counts for w in c)
        self.seeds: dict[tuple, list[int]] = defaultdict(list)
        for k, (_, t) in enumerate(self.templates):
            if t:
                self.seeds[tuple(t[:SEED])].append(k)
        self.seed_sizes = sorted({len(x) for x in self.seeds})
        self.first_words = frozenset(x[0] for x in self.seeds)

    def matches(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, first and last matched word's place) of every notice,
        in the order of the text. Verbatim copies come first; of overlapping ones that with most
        matched words is kept, then that of higher coverage, then the smaller name."""
        words = words_of(text)
        held = self.vocabulary.intersection(words)
        possible = [k for k, c in enumerate(self.counts) if sum(n for w, n in c.items() if w in held) >= self.threshold * len(self.templates[k][1])] if held else []
        if not possible:
            return []
        kept: list[tuple[str, float, int, int, int]] = []
        self._keep(kept, self._verbatim(words))
        edges = [(-1, -1), *((m[3], m[4]) for m in kept), (len(words), len(words))]
        gaps = [(a + 1, b) for (_, a), (b, _) in zip(edges, edges[1:], strict=False) if b > a + 1]
        self._keep(kept, [m for a, b in gaps for m in self._altered(words[a:b], a, possible)])
        return kept

    @staticmethod
    def _keep(kept: list, found: list) -> None:
        for m in sorted(found, key=lambda m: (-m[2], -m[1], m[0], m[3])):
            at = bisect_left(kept, m[3], key=lambda x: x[3])
            if (not at or kept[at - 1][4] < m[3]) and (at == len(kept) or m[4] < kept[at][3]):
                kept.insert(at, m)

    def _verbatim(self, words: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """All word-for-word copies."""
        out = []
        for i, w in enumerate(words):
            if w not in self.first_words:
                continue
            for size in self.seed_sizes:
                for k in self.seeds.get(tuple(words[i : i + size]), ()):
                    if self._same(words, i, self.templates[k][1]):
                        n = len(self.templates[k][1])
                        out.append((self.templates[k][0], 1.0, n, i, i + n - 1))
        return out

    @staticmethod
    def _same(words: list[bytes], at: int, template: list[bytes]) -> bool:
        """Whether the template stands at a place; compared by ever longer pieces."""
        if at + len(template) > len(words):
            return False
        a, step = 0, 8
        while a < len(template):
            if words[at + a : at + a + step][: len(template) - a] != template[a : a + step]:
                return False
            a, step = a + step, 2 * step
        return True

    def _altered(self, words: list[bytes], base: int, possible: list[int]) -> Iterator[tuple[str, float, int, int, int]]:
        """Notices of a stretch between verbatim copies, which begins at ``base``."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.vocabulary:
                places[w].append(i)
        for k in possible:
            size = len(self.templates[k][1])
            if sum(min(n, len(places.get(w, ()))) for w, n in self.counts[k].items()) >= self.threshold * size:
                for name, cover, n, first, last in self._windows(k, words, places) if size < NOTICE else self._grid(k, words):
                    yield name, cover, n, first + base, last + base

    def _grid(self, k: int, words: list[bytes]) -> Iterator[tuple[str, float, int, int, int]]:
        """Notices of a long template: of windows an even step apart that share enough of its words,
        the best one, then those that don't overlap it."""
        name, template = self.templates[k]
        size, count = len(template), self.counts[k]
        found = []
        for width, step in ((size * a // 8, max(1, size * b // 8)) for a, b in WIDTHS):
            there: Counter = Counter()
            shared = begin = end = 0
            for at in range(0, max(1, len(words) - width + step), step):
                for w in words[end : at + width]:  # words that come in, and those that fall out
                    if w in count:
                        there[w] += 1
                        shared += there[w] <= count[w]
                end = max(end, min(len(words), at + width))
                for w in words[begin:at]:
                    if w in count:
                        shared -= there[w] <= count[w]
                        there[w] -= 1
                begin = at
                if shared >= self.threshold * size:
                    pairs = dense(align(template, words[at:end]))
                    if len(pairs) >= self.threshold * size:
                        found.append((name, len(pairs) / size, len(pairs), at + pairs[0][1], at + pairs[-1][1]))
        kept: list = []
        self._keep(kept, found)
        yield from kept

    def scan(self, text: bytes) -> tuple[str | None, float, int | None, int | None]:
        """(license, coverage, first and last matched word's place) of the best notice."""
        return best_of(self.matches(text))

    def _tells(self, k: int, window: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Whether an alignment has the template's deciding words and no other license's between. The
        shortest templates stand only without a word between."""
        at = {j for _, j in pairs}
        if len(self.templates[k][1]) < WHOLE and pairs[-1][1] - pairs[0][1] + 1 > len(pairs):
            return False
        if not self.deciding[k] <= {window[j] for j in at}:
            return False
        return self.strange[k].isdisjoint(window[j] for j in range(pairs[0][1], pairs[-1][1]) if j not in at)

    def _windows(self, k: int, words: list[bytes], places) -> Iterator[tuple[str, float, int, int, int]]:
        """Every notice of one template, from left to right."""
        name, template = self.templates[k]
        size, count = len(template), self.counts[k]
        if sum(min(n, len(places.get(w, ()))) for w, n in count.items()) < self.threshold * size:
            return
        # of the words that may be lacking together one at least is there: windows around the rarest
        # words, as many of them as a covered template can't lack
        spare, rare = size - self.threshold * size, []
        for w in sorted(count, key=lambda w: (len(places.get(w, ())), w)):
            rare.append(w)
            spare -= count[w]
            if spare < 0:
                break
        offsets: dict[bytes, list[int]] = defaultdict(list)
        for o, w in enumerate(template):
            offsets[w].append(o)
        free = 0  # words before it belong to notices already found
        for i, w in sorted((p, w) for w in rare for p in places.get(w, ())):
            if i < free:
                continue
            start, best = max(free, i - size), None
            whole = next((i - o for o in offsets[w] if i - o >= free and words[i - o : i - o + size] == template), None)
            if whole is not None:  # a repeated notice has no unique words in a wider window
                best = (name, 1.0, size, whole, whole + size - 1)
            else:
                window = words[start : i + size]
                there = Counter(window)
                if sum(min(n, there[x]) for x, n in count.items()) < self.threshold * size:
                    continue
                for a, b in [(0, len(window)), *((max(0, i - o - start), i - o - start + size) for o in offsets[w] if size < NOTICE)]:
                    part = window[a:b]
                    pairs = align(template, part)
                    if pairs and len(pairs) >= self.threshold * size and (best is None or len(pairs) > best[2]) and self._tells(k, part, pairs):
                        best = (name, len(pairs) / size, len(pairs), start + a + pairs[0][1], start + a + pairs[-1][1])
            if best:
                yield best
                free = best[4] + 1


def best_of(found: list[tuple[str, float, int, int, int]]) -> tuple[str | None, float, int | None, int | None]:
    """Of a text's notices that with most matched words, then the first."""
    if not found:
        return (None, 0.0, None, None)
    name, cover, _, first, last = max(found, key=lambda m: (m[2], m[1], -m[3]))
    return (name, cover, first, last)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, first_word, last_word of every row's best notice, and all its notices."""
    notice = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        names = [f.name for f in notice]
        for batch in batches:
            found = [scanner.matches(t) for t in utf8_column(batch.column(1))]
            rows = [best_of(m) for m in found]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
            listed = pa.array([[dict(zip(names, x, strict=True)) for x in m] for m in found], pa.list_(notice))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)), listed], names=["doc_id", "license", "coverage", "first_word", "last_word", "notices"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, notices array<struct<license: string, coverage: double, matched: long, first_word: long, last_word: long>>")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
