"""License scans: which license notices a document holds, how much of each, and where.

Method.  Words are runs of letters and digits of the lower-cased text.  The hashes of all
three-word grams are winnowed (the rightmost least hash of every ``WINDOW`` neighbours), for
templates once and for every document; a run of five equal words always shares one.  The
templates' fingerprints form an inverted index.  Hits of a document and template that lie on
nearby diagonals are one candidate, and a banded alignment around them gives the longest
common subsequence of words.  A candidate is reported if that covers at least ``coverage`` of
the template within a passage that is as close to its length; the passage is then masked and the candidate is aligned again, until nothing more
is found, so adjacent copies are found one by one.  Bands are at most half as wide as the
template is long and overlap by half, so the work grows with the number of copies.  Of reports that overlap by
half, the one with more matched words stays, then the one with the higher coverage.

The templates are a small table (pairs, or a DataFrame with license and text) and go to every
task; their size is checked (``MOST`` words).

Defined results.  Null or empty text: nothing.  Null id: reported as null.  Templates under
five words match where all their words are consecutive.  A document that holds a notice twice
reports it twice, next to each other or not.  Repeated rows: each reports.  Other columns are
ignored, whatever their names.  Very long texts: read whole, one at a time.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_rows
from .decontaminate import words_of

GRAM, WINDOW, MOST = 3, 3, 1_000_000

# Notices of public licenses, by SPDX identifier where there is one.
MIT_TERMS = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
ISC_TERMS = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
ZLIB_TERMS = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
ZLIB_REST = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL3_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
AGPL3_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
APACHE_TERMS = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_WARRANTY = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
TEMPLATES = (
    ("MIT", f"{MIT_TERMS} {MIT_WARRANTY}"),
    ("Apache-2.0", f"{APACHE_TERMS} {APACHE_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_NAMES}"),
    ("BSD-2-Clause", f"{BSD_TERMS} {BSD_WARRANTY}"),
    ("ISC", f"{ISC_TERMS} {ISC_WARRANTY}"),
    ("Zlib", f"{ZLIB_TERMS} {ZLIB_REST}"),
    ("GPL-3.0", f"{GPL3_TERMS} {GNU_WARRANTY}"),
    ("AGPL-3.0", f"{AGPL3_TERMS} {GNU_WARRANTY}"),
    ("AGPL-3.0", AGPL3_TERMS),
    ("MIT", MIT_TERMS),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", APACHE_TERMS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", BSD_TERMS),
    ("ISC", ISC_TERMS),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", GPL3_TERMS),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", ZLIB_TERMS),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def winnow(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indexes of the selected grams: the rightmost least of each whole window of one document, or of a shorter document."""
    n = len(gram)
    if not n:
        return np.zeros(0, dtype=np.int64)
    last = np.searchsorted(doc, doc, side="right")
    first = np.searchsorted(doc, doc)
    start = np.arange(n)
    start = start[(start + WINDOW <= last) | (start == first)]
    best = start.copy()
    for k in range(1, WINDOW):
        at = np.minimum(start + k, last[start] - 1)
        best = np.where(gram[at] <= gram[best], at, best)
    return np.unique(best)


def align(template: np.ndarray, text: np.ndarray, low: int, width: int) -> list[int]:
    """Text places of the longest common subsequence in the band low <= text place - template place < low + width.

    Of equally long ones, the traceback takes one that ends first and, of those, places near its end.
    """
    n, m = len(template), len(text)
    score = np.zeros((n + 1, width + 2), dtype=np.int32)
    hits = np.zeros((n + 1, width + 2), dtype=bool)
    for i in range(1, n + 1):
        # column c of row i stands for text place i - 1 + low + c - 1
        at = i - 1 + low + np.arange(width)
        inside = (at >= 0) & (at < m)
        hits[i, 1:-1][inside] = text[at[inside]] == template[i - 1]
        up = np.append(score[i - 1, 2:], 0)[:width]  # same text place, previous template word
        new = np.maximum(score[i - 1, 1:-1] + hits[i, 1:-1], up)
        score[i, 1:-1] = np.maximum.accumulate(new)
    c, i = int(score[n, 1:-1].argmax()) + 1, n
    places = []
    while i > 0 and score[i, c] > 0:
        if hits[i, c] and score[i, c] == score[i - 1, c] + 1:
            places.append(i - 1 + low + c - 1)
            i -= 1
        elif score[i, c] == score[i, c - 1] and c > 1:
            c -= 1
        elif c < width and score[i, c] == score[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            i -= 1
    return places[::-1]


def passage(places: list[int]) -> tuple[int, int, int]:
    """(matches, start, end) of the stretch of places with the most matches less half the words between them; the first of the best.

    This cuts off words that the alignment took from a neighbour.
    """
    best, first, worth = (0, 0, 0, 0), 0, 0
    for k, p in enumerate(places):
        worth -= p - places[k - 1] - 1 if k else 0
        if worth <= 0:
            first, worth = k, 0
        worth += 2
        if worth > best[0]:
            best = (worth, k + 1 - first, places[first], p + 1)
    return best[1:]


class TemplateIndex:
    def __init__(self, templates: list[tuple[str, str]]):
        raw = [t.lower().encode() for _, t in templates]
        words = words_of(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(x) for x in raw]))
        if len(words.start) > MOST:
            raise ValueError(f"the templates hold more than {MOST} words")
        self.names = [n for n, _ in templates]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        at, gram = words.grams(GRAM)
        doc = np.searchsorted(words.first, at, side="right") - 1
        # of a template too short for the guarantee, every gram goes in
        short = np.diff(words.first)[doc] < GRAM + WINDOW - 1
        pick = np.union1d(winnow(gram, doc), np.flatnonzero(short))
        order = pick[np.argsort(gram[pick], kind="stable")]
        self.gram, self.template, self.place = gram[order], doc[order], at[order] - words.first[doc[order]]
        self.all_grams = bool(short.any())

    def scan(self, words: K.Words, coverage: float) -> list[tuple[int, str, float, int, int, int]]:
        """(document, name, coverage, matched words, start, end)."""
        at, gram = words.grams(GRAM)
        doc = np.searchsorted(words.first, at, side="right") - 1
        if not self.all_grams:
            pick = winnow(gram, doc)
            at, gram, doc = at[pick], gram[pick], doc[pick]
        lo, hi = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, side="right")
        groups: dict[tuple[int, int], list[int]] = {}
        for k in np.flatnonzero(hi > lo):
            for e in range(lo[k], hi[k]):
                groups.setdefault((int(doc[k]), int(self.template[e])), []).append(int(at[k] - words.first[doc[k]] - self.place[e]))
        found: dict[int, list[tuple[float, int, int, int, str]]] = {}
        for (d, t), diagonals in groups.items():
            n = len(self.words[t])
            text = words.hash[words.first[d] : words.first[d + 1]]
            own = False
            slack = 0 if n < GRAM + WINDOW - 1 else max(4, n // 8)
            for a, b in _bands(sorted(set(diagonals)), n):
                low, high = a - slack, b + slack
                base = max(0, low)
                while True:
                    matched, start, end = passage(align(self.words[t], text[base : high + n + 1], low - base, high - low + 1))
                    if not matched or matched < coverage * n or coverage * (end - start) > n:
                        break
                    found.setdefault(d, []).append((matched / n, matched, base + start, base + end, self.names[t]))
                    text, own = text if own else text.copy(), True
                    text[base + start : base + end] = 0  # a word's hash is odd
        out = []
        for d, reports in found.items():
            kept: list[tuple[float, int, int, int, str]] = []
            for r in sorted(reports, key=lambda r: (-r[1], -r[0], r[2], r[4])):
                if all(2 * (min(r[3], k[3]) - max(r[2], k[2])) < min(r[3] - r[2], k[3] - k[2]) for k in kept):
                    kept.append(r)
            out += [(d, name, cov, matched, a, b) for cov, matched, a, b, name in kept]
        return out


def _bands(diagonals: list[int], n: int) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring diagonals, at most n / 2 apart, so that two copies don't share a band; those of one neighbourhood overlap by half."""
    at = 0
    for k, x in enumerate(diagonals):
        if k + 1 < len(diagonals) and diagonals[k + 1] - x <= n // 2:
            continue
        low, high = diagonals[at], x
        at = k + 1
        while high - low > n // 2:
            yield low, low + n // 2
            low += max(1, n // 4)
        yield low, high


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Reports: doc_id, license, coverage, matched, start, end (words of the document)."""
    arrow_rows(docs.sparkSession)
    if isinstance(templates, DataFrame):
        table = templates.select("license", "text").filter("license is not null and text is not null")
        if (table.agg(F.sum(F.length("text"))).head()[0] or 0) > 10 * MOST:
            raise ValueError(f"the templates hold more than {MOST} words")
        templates = sorted((r.license, r.text) for r in table.collect())
    index = TemplateIndex(list(templates))
    names = ["doc_id", "license", "coverage", "matched", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, bounds in K.slices(batch.column(1)):
                found = index.scan(words_of(data, bounds), coverage)
                if found:
                    d, name, cov, matched, a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + x for x in d])), pa.array(name), pa.array(cov), pa.array(matched, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, license string, coverage double, matched long, start long, end long")
