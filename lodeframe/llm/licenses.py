"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, A-Z lower-cased.  Of every ``window`` grams
of ``gram`` words in a row the least hash is a fingerprint; those of the templates
form an inverted index, bounded by the template list, that every task gets.  Long
templates are winnowed (three words, window 2), so four equal words in a row
share a fingerprint; of short ones all pairs of words are kept.

Fingerprints of one template that lie close in a document are one candidate.
Template and document are aligned in a band that covers all their diagonals:
a matched word counts 64, an inserted one costs 1, so that a licence with a
passage put into its middle is one match, and repeated notices are as many.
Matched words over template words is the coverage, first to last matched word
the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALPHANUMERIC, Words, mix, words
from .storage import in_batches

#: (words of a gram, grams of a window) of short and of long templates; a long one has LONG words or more.
SHORT_GRAMS, LONG_GRAMS, LONG = (2, 1), (3, 2), 40
BAND, COVERAGE, MATCH = 12, 0.8, 64

#: Wording of public licences, of their headers, and of the notices that name them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def _grams(name: np.ndarray, text: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each gram that lies within one text."""
    if name.size < gram:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = name.size - gram + 1
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * np.uint64(0x9E3779B97F4A7C15) + name[k : k + n]
    inside = text[:n] == text[gram - 1 :]
    return np.flatnonzero(inside), mix(total)[inside]


def winnow(at: np.ndarray, value: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams that are the least of some window; texts with fewer grams than a window keep them all."""
    if not at.size or window == 1:
        return at, value
    owner = text[at]
    keep = np.zeros(at.size, bool)
    n = at.size - window + 1
    if n > 0:
        spans = np.flatnonzero(owner[:n] == owner[window - 1 :])
        stack = np.stack([value[k : k + n][spans] for k in range(window)])
        # The last of equal values, so the windows that follow choose it too.
        keep[spans + window - 1 - np.argmin(stack[::-1], axis=0)] = True
    keep |= np.bincount(owner)[owner] < window
    return at[keep], value[keep]


class Index:
    """Fingerprints of templates by kind, sorted, with template and word place; ``fewest`` a candidate of each must have.

    In a short template's copy at most n - ceil(0.8 n) words are missing, and if
    others are put in in as many places at most, so many pairs of words are left.
    """

    def __init__(self, templates: dict[str, str], least: float) -> None:
        self.names = list(templates)
        self.words = [next(words(pa.array([t]), ALPHANUMERIC)).name for t in templates.values()]
        self.least = [int(np.ceil(least * w.size - 1e-9)) for w in self.words]
        self.fewest = [1 if w.size >= LONG else max(1, k - 2 * (w.size - k) - 1) for w, k in zip(self.words, self.least, strict=True)]
        self.kinds = []
        for kind, long in ((SHORT_GRAMS, False), (LONG_GRAMS, True)):
            value, template, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for t, name in enumerate(self.words):
                if (name.size >= LONG) == long:
                    text = np.zeros(name.size, np.int64)
                    at, v = winnow(*_grams(name, text, kind[0]), text, kind[1])
                    value.append(v)
                    place.append(at)
                    template.append(np.full(at.size, t))
            order = np.argsort(np.concatenate(value), kind="stable")
            self.kinds.append((kind, *(np.concatenate(x)[order] for x in (value, template, place))))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, template and template word of each shared fingerprint."""
        out = []
        for (gram, window), known, template, place in self.kinds:
            at, value = winnow(*_grams(w.name, w.text, gram), w.text, window)
            low, high = np.searchsorted(known, value, "left"), np.searchsorted(known, value, "right")
            count = high - low
            row = np.repeat(np.arange(at.size), count)
            entry = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count) + low[row]
            out.append((at[row], template[entry], place[entry]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def align(template: np.ndarray, document: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last matched document word + 1) of the best alignment whose document place
    minus template place stays between ``low`` and ``high``; a match counts MATCH, an inserted word costs 1."""
    width, n = high - low + 1, template.size
    # Cell (i, d) stands for i template words and document words up to i + low + d.
    place = np.arange(n)[:, None] + low + np.arange(width)[None, :]
    inside = (place >= 0) & (place < document.size)
    match = np.where(inside, document[np.clip(place, 0, max(document.size - 1, 0))] == template[:, None], False)
    best, slope = np.zeros((n + 1, width), np.int64), np.arange(width)
    for i in range(n):
        above = np.append(best[i, 1:], 0)  # template word left out
        now = np.maximum(above, np.where(match[i], best[i] + MATCH, 0))
        best[i + 1] = np.maximum(np.maximum.accumulate(now + slope) - slope, 0)
    i, d = n, int(np.argmax(best[n]))
    matched, first, last = 0, -1, 0
    while i > 0 and best[i, d] > 0:
        if match[i - 1, d] and best[i, d] == best[i - 1, d] + MATCH:
            matched += 1
            first = int(place[i - 1, d])
            last = last or first + 1
            i -= 1
        elif d < width - 1 and best[i - 1, d + 1] == best[i, d]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, first, last


def _matches(index: Index, k: int, document: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end, matched words) of the matches of template ``k`` among its hits (in order) in one text."""
    template = index.words[k]
    # Hits so far apart that no match could span them are taken one cluster after another.
    cuts = np.flatnonzero(np.diff(at) > MATCH + template.size) + 1
    todo = [(a, b, 0, document.size) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), at.size], strict=True)]
    out = []
    while todo:
        a, b, lo, hi = todo.pop()  # hits, and the words that no match has taken
        if np.unique(at[a:b]).size < index.fewest[k]:
            continue
        shift = at[a:b] - place[a:b]
        if np.ptp(shift) > 4 * (MATCH + template.size):
            # A long cluster is cut where the band is wide enough for any match; the pieces overlap by one.
            reach = 2 * (MATCH + template.size)
            stop = a + int(np.searchsorted(at[a:b], at[a] + 2 * reach))
            more = a + int(np.searchsorted(at[a:b], at[a] + reach))
            if stop < b:
                todo.append((max(more, a + 1), b, lo, hi))
                b = max(stop, a + 1)
                shift = at[a:b] - place[a:b]
        matched, first, last = align(template, document[lo:hi], int(shift.min()) - BAND - lo, int(shift.max()) + BAND - lo)
        if matched >= index.least[k]:
            first, last = first + lo, last + lo
            out.append((first, last, matched))
            todo += [(a, a + int(np.searchsorted(at[a:b], first)), lo, first), (a + int(np.searchsorted(at[a:b], last)), b, last, hi)]
    return out


_SCHEMA = "doc_id long, license string, start long, end long, matched long, template_words long, coverage double"


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, out = batch.column("doc_id"), []
        for w in words(batch.column("text"), ALPHANUMERIC):
            at, template, place = index.hits(w)
            order = np.lexsort((place, at, template, w.text[at]))
            at, template, place = at[order], template[order], place[order]
            text = w.text[at]
            new = np.ones(at.size, bool)
            new[1:] = (text[1:] != text[:-1]) | (template[1:] != template[:-1])
            starts = np.flatnonzero(new)
            begin = np.searchsorted(w.text, np.arange(w.offsets.size))
            for s, e in zip(starts.tolist(), np.append(starts[1:], at.size)[: starts.size].tolist(), strict=True):
                t, k = int(text[s]), int(template[s])
                if e - s < index.fewest[k]:
                    continue
                lo, hi = int(begin[t]), int(begin[t + 1])
                for first, last, matched in _matches(index, k, w.name[lo:hi], at[s:e] - lo, place[s:e]):
                    raw, base = w.data[w.offsets[t] : w.offsets[t + 1]].tobytes(), int(w.offsets[t])
                    span = [len(raw[: int(p) - base].decode()) for p in (w.start[lo + first], w.end[lo + last - 1])]
                    out.append((t + w.first, index.names[k], *span, matched, index.words[k].size, matched / index.words[k].size))
        cols = list(zip(*dict.fromkeys(out), strict=True)) or [[]] * 7
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], [f.split()[0] for f in _SCHEMA.split(", ")])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """A row for each place where a text covers a template to ``least`` or more; start and end in code points.

    Templates need two words at least.  Null and empty texts have no row; rows
    that share a doc_id are scanned one by one; a null doc_id is carried along.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(source, partial(_scan, index=Index(templates, least)), _SCHEMA)
