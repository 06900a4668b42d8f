"""License scans (operator 2): winnowed fingerprints in an inverted index, then banded sequence alignment.

Templates and texts are sequences of words in lower case without marks at their ends. Three-word runs are hashed and
winnowed over three neighbours, so any five words that a text shares with a template share a chosen fingerprint.
Fingerprints that meet name a template and a diagonal; neighbouring diagonals form one candidate, and an alignment in a
band around it counts the template's words that the text has in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, importable, sole_memory
from .lexicon import Lexicon, Members, runs

RUN, WINDOW = 3, 3

#: Well-known license notices, standard headers, and the texts of short licenses by their parts: a text that
#: has the grant without the disclaimer, or the other way round, is told by what it has.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause third condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def winnow(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest code (the rightmost of equals) of each window; of all of them if there are fewer."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.intp)
    w = min(window, n)
    windows = np.lib.stride_tricks.sliding_window_view(codes, w)
    return np.unique(np.arange(n - w + 1) + (w - 1 - np.argmin(windows[:, ::-1], axis=1)))


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> list[tuple[int, int]]:
    """The longest common subsequence of a and b with places (i, j), |j - i - shift| <= band; the earliest on ties."""
    width = 2 * band + 1
    n = len(a)
    score = np.zeros((n + 1, width + 2), np.int32)  # score[i, d + 1]: for a[i:] against b[i + shift - band + d :]
    for i in range(n - 1, -1, -1):
        j0 = i + shift - band
        for d in range(width - 1, -1, -1):
            j = j0 + d
            if j >= len(b):
                continue
            best = max(score[i + 1, d], score[i, d + 2])
            if j >= 0 and a[i] == b[j]:
                best = max(best, score[i + 1, d + 1] + 1)
            score[i, d + 1] = best
    out, i, d = [], 0, 0
    while i < n and d < width:
        j = i + shift - band + d
        if j >= len(b) or score[i, d + 1] == 0:
            break
        if j >= 0 and a[i] == b[j] and score[i, d + 1] == score[i + 1, d + 1] + 1:
            out.append((i, j))
            i += 1
        elif score[i, d + 1] == score[i + 1, d]:
            i, d = i + 1, d - 1
            if d < 0:
                break
        else:
            d += 1
    return out


def _windows(shifts: list[int], width: int) -> list[tuple[int, int]]:
    """(lowest, highest) of sorted diagonals in windows of a width, each half over the one before; all within half a width
    of each other share a window. Without it, a text of a template's phrases over and over is a band as wide as the text."""
    if shifts[-1] - shifts[0] <= width:
        return [(shifts[0], shifts[-1])]
    out, at = [], 0
    while at < len(shifts):
        end = bisect_right(shifts, shifts[at] + width)
        out.append((shifts[at], shifts[end - 1]))
        if end == len(shifts):
            break
        at = max(at + 1, bisect_right(shifts, shifts[end - 1] - (width + 1) // 2 - 1))
    return out


class Scanner:
    """Templates with the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.lexicon = Lexicon(templates.values())
        self.templates = [(name, words) for name, t in sorted(templates.items()) if len(words := self.lexicon.read(t)[0])]
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.sizes = sorted({min(RUN, len(w)) for _, w in self.templates})
        for at, (_, words) in enumerate(self.templates):
            codes = runs(words, min(RUN, len(words)))
            for place in winnow(codes).tolist():
                self.index.setdefault(int(codes[place]), []).append((at, place))
        self.prints = Members(self.index)

    def _candidates(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest diagonal, highest diagonal), from the text's own winnowed fingerprints."""
        met: dict[int, set[int]] = {}
        for k in self.sizes:
            codes = runs(numbers, k)
            if not len(self.prints.where(codes)):
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes != 0).astype(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # stretches of known words
                chosen = winnow(codes[a:b]) + a
                for place in chosen[self.prints.where(codes[chosen])].tolist():
                    for at, where in self.index[int(codes[place])]:
                        met.setdefault(at, set()).add(place - where)
        out = []
        for at, shifts in met.items():
            slack = self._band(at)
            group: list[int] = []
            for s in sorted(shifts):
                if group and s - group[-1] > slack:
                    out.extend((at, *w) for w in _windows(group, 8 * slack))
                    group = []
                group.append(s)
            out.extend((at, *w) for w in _windows(group, 8 * slack))
        return sorted(out)

    def _band(self, at: int) -> int:
        return max(2, len(self.templates[at][1]) // 8)

    def find(self, text: str, coverage: float) -> list[tuple[str, float, int, int, int, int, int]]:
        """(license, coverage, words matched, first word, word after the last, first character, character after)."""
        numbers, places = self.lexicon.read(text)
        out, spots = {}, None
        for at, low, high in self._candidates(numbers):
            name, words = self.templates[at]
            band = (high - low + 1) // 2 + self._band(at)
            near = numbers[max(0, low - band - 1) : high + band + 1 + len(words)]
            if np.isin(words, near).sum() < coverage * len(words):  # no alignment has more words than the text has here
                continue
            pairs = align(words, numbers, (low + high) // 2, band)
            if not pairs or len(pairs) < coverage * len(words):
                continue
            if spots is None:
                spots = _spots(text)
            first, last = int(places[pairs[0][1]]), int(places[pairs[-1][1]])
            out[name, round(len(pairs) / len(words), 6), len(pairs), first, last + 1, spots[first][0], spots[last][1]] = None
        return list(out)


def _spots(text: str) -> list[tuple[int, int]]:
    """Where the words of str.split() stand."""
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = 0.8) -> DataFrame:
    """(id, license, coverage, matched_words, word_start, word_end, char_start, char_end) of every template found.

    coverage is the share of the template's words that stand in the text in order within the band; spans end before
    their end. A template may be found several times in a text; a short notice inside a longer header is reported
    beside it. Templates shorter than a run are one fingerprint. Null and empty texts match nothing; repeated rows
    repeat; an empty table gives no rows; other columns play no part. The templates are sent to every executor and
    may have 16 MB.
    """
    if sum(len(t) for t in templates.values()) > 16 << 20:
        raise ValueError("templates of more than 16 MB: scan in several calls")
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        sole_memory("license_scan", scanner.lexicon.clear)
        kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5)
        for b in batches:
            rows = [(i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for hit in scanner.find(t, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["id", "license", "coverage", "matched_words", "word_start", "word_end", "char_start", "char_end"])

    source = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, license string, coverage double, matched_words long, word_start long, word_end long, char_start long, char_end long")


__all__ = ["TEMPLATES", "Scanner", "align", "scan", "winnow"]
