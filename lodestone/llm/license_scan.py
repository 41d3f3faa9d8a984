"""License scans: windows of a text are matched to templates by MinHash bands.

Templates are grouped by their number of five-word shingles, up to M = 1, 2, 4, 8 ... in a
group.  A text is cut into windows of 3 M shingles that begin every M shingles, so any
run of 2 M shingles lies whole in one of them, which leaves a template room for as many
inserted words again.  A window with 80 % of a template of over M / 2 shingles has a
similarity of 0.4 / 3.1 to it at least; with BANDS bands of one value the two collide with
probability 1 - (1 - 0.4 / 3.1) ** BANDS, over 0.9999999.  Candidates are confirmed by exact
containment of the template's shingles.

Minima are taken once over single shingles and then over twice as long pieces at a time,
so that all groups together cost about two passes.  A band's hash is a bijection of 32-bit
values, so a window has a template's minimum only if it holds the very value that gives it:
the passes leave out the stretches of a text, and the texts, in which no window holds a
value of any template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import texts_by_bytes
from ._minimizers import mix64
from .substring_dedup import split_words

BANDS = 128
WIDTH = 5
BATCH_BYTES = 1 << 20  # of texts that are scanned together
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS, dtype=np.uint64).astype(np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Letters and digits in lower case; everything else in ASCII parts words.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())

# Notices by which texts state their licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed five-word shingles of all texts end to end, and the texts' n + 1 offsets."""
    tokens = split_words([t.translate(_FOLD) for t in texts])
    w, bounds = tokens.values, tokens.bounds
    if len(w) < WIDTH:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    h = w[: len(w) - WIDTH + 1].copy()
    for j in range(1, WIDTH):
        h = h * _ODD + w[j : len(w) - WIDTH + 1 + j]
    counts = np.maximum(0, np.diff(bounds) - WIDTH + 1)
    begin = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return mix64(h)[begin + np.arange(counts.sum())], np.concatenate([[0], np.cumsum(counts)])


class Library:
    """Templates with their shingles, by group, and the min-hashes that find them."""

    def __init__(self, templates: dict[str, str]):
        self.sets: list[tuple[str, np.ndarray]] = []
        self.groups: dict[int, list[dict[int, list[int]]]] = {}  # by size, then by band: min-hash to templates
        for name, text in templates.items():
            s = np.unique(shingles([text.encode()])[0])
            if not len(s):
                raise ValueError(f"template {name} has fewer than {WIDTH} words")
            tables = self.groups.setdefault(1 << (len(s) - 1).bit_length(), [{} for _ in range(BANDS)])
            high = (s >> np.uint64(32)).astype(np.uint32)
            for band, table in enumerate(tables):
                table.setdefault(int((high * _A[band] + _B[band]).min()), []).append(len(self.sets))
            self.sets.append((name, s))
        self.values = np.unique(np.concatenate([s for _, s in self.sets]) >> np.uint64(32)).astype(np.uint32) if self.sets else np.empty(0, np.uint32)
        self.marks = np.zeros(1 << 16, bool)
        self.marks[self.values >> np.uint32(16)] = True
        self.wanted = {size: [np.array(list(table), np.uint32) for table in tables] for size, tables in self.groups.items()}


def _stretches(high: np.ndarray, bounds: np.ndarray, library: Library) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the stretches begin and end whose windows may hold a value of a template, and
    the text of each.

    They begin at multiples of the largest M, two before that of the value and, if the text
    is that long, end three after it, so every window with the value lies whole in one of
    them, at a multiple of its own M.
    """
    at = np.flatnonzero(library.marks[high >> np.uint32(16)])
    at = at[np.isin(high[at], library.values)]
    text = np.searchsorted(bounds, at, side="right") - 1
    most = max(library.groups, default=1)
    piece = (at - bounds[text]) // most
    begin, end = bounds[text] + np.maximum(0, piece - 2) * most, np.minimum(bounds[text + 1], bounds[text] + (piece + 3) * most)
    new = np.ones(len(at) + 1, bool)  # the last one closes the last stretch
    new[1:-1] = (text[1:] != text[:-1]) | (begin[1:] > end[:-1])
    return begin[new[:-1]], end[new[1:]], text[new[:-1]]


def _levels(bounds: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray | None, np.ndarray, np.ndarray, list]]:
    """Pieces of the texts, 1, 2, 4 ... shingles long from the beginning of each: the length
    if it is one of ``sizes``, else 0; where a piece's first half is among the level before;
    the text of each piece and its number there; and which pieces the next and the one after
    it follow in the same text."""
    text, most, starts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), 1, None
    while True:
        number = np.arange(len(text)) - np.searchsorted(text, text)
        follow = [(step, np.flatnonzero(text[step:] == text[:-step])) for step in (1, 2)] if most in sizes else []
        yield most if most in sizes else 0, starts, text, number, follow
        if most >= max(sizes):
            return
        starts = np.flatnonzero(number % 2 == 0)
        text, most = text[starts], 2 * most


def scan_texts(texts: list[bytes], library: Library, containment: float) -> list[tuple[int, str, float, int, int]]:
    """(text, template, containment, start word, windows) of the best window of each match."""
    values, bounds = shingles(texts)
    begins, ends, of = _stretches((values >> np.uint64(32)).astype(np.uint32), bounds, library)
    if not len(begins):
        return []
    before = begins - bounds[of]
    values = np.concatenate([values[low:high] for low, high in zip(begins, ends, strict=True)])
    bounds = np.concatenate([[0], np.cumsum(ends - begins)])
    levels = list(_levels(bounds, list(library.groups)))
    high = (values >> np.uint64(32)).astype(np.uint32)
    candidates: set[tuple[int, int, int]] = set()
    for band in range(BANDS):  # one at a time, so that a long text needs no more than a few arrays
        least = high * _A[band] + _B[band]
        for level, (size, starts, _, _, follow) in enumerate(levels):
            least = least if starts is None else np.minimum.reduceat(least, starts)
            if size:
                # A window is a piece and the next two, as far as they are of the same text.
                joined = least.copy()
                for step, same in follow:
                    joined[same] = np.minimum(joined[same], least[same + step])
                table = library.groups[size][band]
                for w in np.flatnonzero(np.isin(joined, library.wanted[size][band])).tolist():
                    candidates.update((level, w, t) for t in table[int(joined[w])])
    best: dict[tuple[int, int], list] = {}
    for level, w, t in sorted(candidates):
        size, _, text, number, _ = levels[level]
        i = int(text[w])
        begin = int(bounds[i] + number[w] * size)
        own, template = values[begin : min(begin + 3 * size, int(bounds[i + 1]))], library.sets[t][1]
        found = np.isin(template, own)
        if found.sum() >= containment * len(template) - 1e-9:
            share = float(found.mean())
            at = int(before[i] + begin - bounds[i] + np.flatnonzero(np.isin(own, template))[0])
            seen = best.setdefault((int(of[i]), t), [share, at, 0])
            if share > seen[0]:
                seen[0], seen[1] = share, at
            seen[2] += 1
    return [(i, library.sets[t][0], share, at, n) for (i, t), (share, at, n) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8) -> DataFrame:
    """A row for each document and template that a window of it contains to ``containment``
    or more of the template's shingles: doc_id, license, containment (the best window's),
    start_word (where the first shared shingle of that window begins, words being runs of
    letters and digits), n_windows.

    Null, empty and short texts match nothing; repeated rows match again; null ids are
    passed on; other columns are not read, whatever they are called.  A template needs five
    words.  ``templates``, name to text, replaces the library, whose texts may be whole
    licenses.  The library: notices and SPDX lines, and the texts of MIT, ISC, BSD-2-Clause
    and zlib; a license stated in other words is not found.  Templates that share most of
    their shingles, such as the notices of GPL and AGPL, may both match; the containment
    tells them apart.  A very long text is scanned whole.
    """
    library = Library(TEMPLATES if templates is None else templates)
    names = ["doc_id", "license", "containment", "start_word", "n_windows"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in texts_by_bytes(batch, BATCH_BYTES):
                rows = scan_texts(texts, library, containment)
                ids = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([ids, *(pa.array([r[j + 1] for r in rows], k) for j, k in enumerate(kinds))], names=names)

    texts = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS binary) AS text")
    return texts.mapInArrow(scanned, "doc_id long, license string, containment double, start_word long, n_windows long")
