"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams, with size bounds."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.llm.common import mapped, small_batches, texts_of

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = _BSD_2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {0} for more details."""

#: (licence, text): notices of a line and whole licence texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
     or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
     CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
     limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License")),
    ("AGPL-3.0", _GNU.format("Affero General Public License")),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
     compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
     non-commercial, and by any means."""),
]

_TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")
_OWNER = regex.compile(r"(?im)^[^\w\n]*(?:copyright|\(c\)|©).*\d{4}.*$")
#: Begins of windows that are extended together.
BLOCK = 4096


def words_of(text: str) -> list[str]:
    """Lower-cased words; dots and hyphens inside a word belong to it, so versions and short names stay whole."""
    return "\n".join(_TOKEN.findall(text)).lower().split("\n") if _TOKEN.search(text) else []


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams by all bigrams, repeats counted."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Template:
    """A template's bigrams by number, and how often it has each."""

    def __init__(self, name: str, counts: Counter, ratio: float):
        self.name, self.size = name, counts.total()
        #: Size bounds: a window of m bigrams reaches the threshold only with `least` common ones or more, and m `most` at most.
        self.least, self.most = math.ceil(self.size * ratio - 1e-9), int(self.size / ratio + 1e-9)
        self.own = {b: i for i, b in enumerate(counts)}
        self.counts = np.array([*counts.values(), 0], np.int32)  # the last stands for bigrams of other templates or none


class Scanner:
    """Finds where a text holds a licence: windows of its words whose bigrams reach the threshold with a template's.

    With the threshold t, a window that reaches it has n t / (2 - t) of the template's n bigrams at least and n (2 - t) / t bigrams
    at most. So windows are looked for only where that many of the template's bigrams lie that close together; ordinary text
    costs a look-up for each pair of words."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        counted = [(name, bigrams(words)) for name, text in templates if (words := words_of(text))]
        self.templates = [Template(name, c, threshold / (2 - threshold)) for name, c in counted]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for _, c in counted for b in c for w in b if w), 1)}
        pairs = {b: i for i, b in enumerate(dict.fromkeys(b for _, c in counted for b in c if b[1]))}
        self.singles = {b[0] for _, c in counted for b in c if not b[1]}
        self.width = len(self.words) + 1
        codes = np.array([self.words[x] * self.width + self.words[y] for x, y in pairs], np.int64)
        order = np.argsort(codes)
        self.codes, self.numbers = codes[order], np.arange(len(pairs))[order]
        # numbers of bigrams to each template's own numbers
        self.local = np.array([[t.own.get(b, len(t.own)) for b in pairs] + [len(t.own)] for t in self.templates], np.int32).reshape(len(self.templates), len(pairs) + 1)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each pair of neighbouring words; what no template has is the last number."""
        ids = np.fromiter((get(w, 0) for get in (self.words.get,) for w in words), np.int64, len(words))
        codes = ids[:-1] * self.width + ids[1:]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], len(self.codes))

    def _windows(self, t: Template, local: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first bigram, bigrams) of each begin's best window that reaches the threshold, the longest of equals. Only
        begins and ends at the template's bigrams count: without another one at its end a window is better."""
        hits = np.flatnonzero(local < len(t.own))
        if len(hits) < t.least:
            return
        near = hits[t.least - 1 :] - hits[: len(hits) - t.least + 1] < t.most
        begins = hits[: len(near)][near]
        for at in range(0, len(begins), BLOCK):
            some = begins[at : at + BLOCK]
            rows = np.arange(len(some))
            seen = np.zeros((len(some), len(t.counts)), np.int32)
            common, best, size = np.zeros(len(some), np.int64), np.zeros(len(some)), np.zeros(len(some), np.int64)
            for m in range(min(t.most, len(local) - int(some[0]))):
                place = some + m
                b = np.where(place < len(local), local[np.minimum(place, len(local) - 1)], len(t.own))
                seen[rows, b] += 1
                common += seen[rows, b] <= t.counts[b]
                score = 2 * common / (m + 1 + t.size)
                better = (score >= best) & (b < len(t.own))
                best[better], size[better] = score[better], m + 1
            good = best >= self.threshold
            yield from zip(best[good].tolist(), some[good].tolist(), size[good].tolist(), strict=True)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, begin, end) of the matches in text order: of windows that overlap the one with the higher
        coefficient, then the longer, the earlier, the first name. Lines that only name an owner and year are left out."""
        if _OWNER.search(text):
            text = _OWNER.sub(lambda m: " " * len(m.group()), text)
        words = words_of(text)
        hits: list[tuple[float, int, int, str]] = []  # -coefficient, -words, first word, licence
        if len(words) > 1 and len(self.codes):
            numbers = self._numbers(words)
            if (numbers < len(self.codes)).any():
                for t, local in zip(self.templates, self.local, strict=True):
                    hits += [(-score, -m - 1, at, t.name) for score, at, m in self._windows(t, local[numbers])]
        if self.singles and self.singles.intersection(words):
            hits += [(-1.0, -1, i, t.name) for t in self.templates for i, w in enumerate(words) if (w, "") in t.own]
        if not hits:
            return []
        begins, ends, kept = [], [], []  # of the matches so far, which are apart
        for score, n, at, name in sorted(hits):
            i = bisect_left(begins, at)
            if (i == 0 or ends[i - 1] <= at) and (i == len(begins) or at - n <= begins[i]):
                begins.insert(i, at)
                ends.insert(i, at - n)
                kept.insert(i, (name, -score))
        places = [m.span() for m in _TOKEN.finditer(text)]
        return [(name, score, places[a][0], places[b - 1][1]) for (name, score), a, b in zip(kept, begins, ends, strict=True)]


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and matches (array of license, dice, start, end in code points) of every row.

    A licence is found wherever it lies in the text: windows of words are compared with the templates, where size bounds allow
    a match (Scanner). Nothing is shuffled; templates travel with the task, and memory follows the longest text.

    Defined results: null and empty texts, and texts without a match, have an empty array; overlapping matches give the one
    with the higher coefficient, then the longer, the earlier, the first name; no templates find nothing; ids may be null or
    repeat; an empty table gives no rows; other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in small_batches(batches):
            out = [[{"license": n, "dice": s, "start": x, "end": y} for n, s, x, y in scanner.scan(t)] for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, fields)], ["_id", "matches"])

    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return mapped(picked, run, f"_id {kind}, matches array<struct<license:string,dice:double,start:long,end:long>>").withColumnRenamed("_id", id_col)
