"""License scans. Winnowed fingerprints of templates form an inverted index; a document's winnowed fingerprints that hit
it give candidates (document, template, diagonal); a banded alignment around each diagonal then gives the matched
words, the coverage of the template and the span.

Texts are lower-cased and cut into words of letters and digits. Any run of K + W - 1 = 4 template words in a text gives
a common fingerprint. Winnowing keeps the smallest of every W neighbouring hashes of K words; a text or template with
fewer words than K has one fingerprint of all its words. Around such a run, every alignment within BAND diagonals that
covers enough of the template on words that no other match has taken is reported. Licenses of one family hold each other's
words; of matches that share their span the closest one is marked ``best`` and the others stay as runners-up.

Null and empty texts have no matches; very long texts are scanned whole; matches of one template are apart from each
other and numbered in order, ties go to the later start; repeated rows are scanned one by one; an empty table gives no
rows; extra columns are ignored. Templates come as a dictionary or as a table (``templates``); the index is as large as
they are and is refused beyond ``MAX_WORDS`` words.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontam import _WORD, words

K = 3
W = 2
BAND = 6
MAX_WORDS = 5_000_000
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {2}"
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
#: Whole public license texts (of the long licenses the notice that files carry) and one-line notices. More can be passed.
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0-or-later": _GNU.format("Affero General Public License"),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_BSD.format('1. ', '2. ', '')}{_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD.format('1. ', '2. ', '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ')}{_BSD_WARRANTY}",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": _GNU.format("General Public License"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0-or-later": _GNU.format("Lesser General Public License"),
    "MIT": f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}",
    "MIT-0": f"{_GRANT}. {_WARRANTY}",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": f'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY.replace(" OR COPYRIGHT HOLDERS", "")} For more information, please refer to https://unlicense.org/',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates(rows: DataFrame, name_col: str = "name", text_col: str = "text") -> dict[str, str]:
    """Templates from a table; its size is checked before anything is collected. Of a repeated name the text that sorts first."""
    held = rows.where(F.col(name_col).isNotNull() & F.col(text_col).isNotNull())
    if held.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0] > 8 * MAX_WORDS:
        raise ValueError("too much template text for one index; scan in several calls")
    return {r[0]: r[1] for r in held.groupBy(name_col).agg(F.min(text_col)).collect()}


def fingerprints(hashes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen fingerprints of word-hash sequences laid end to end: value, sequence, position of the first word."""
    total = len(hashes)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seq = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum(lens) - lens
    left = (first + lens)[seq] - np.arange(total)  # words from here to the sequence's end
    size = np.minimum(K, lens[seq])
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes.astype(np.uint64), np.zeros(K, np.uint64)])
    for j in range(K):
        h = np.where(j < size, (h ^ padded[j : j + total]) * np.uint64(0x9E3779B97F4A7C15), h)
        h ^= h >> np.uint64(29)
    top = np.uint64(2**64 - 1)
    h = np.where(left >= size, h, top)
    keep = np.zeros(total + 1, bool)
    nxt = np.concatenate([h[1:], [top]])
    same = np.concatenate([seq[1:] == seq[:-1], [False]]) & (nxt != top)
    at = np.arange(total)
    keep[np.where(same & (nxt <= h), at + 1, at)[same]] = True  # the smaller of each two neighbours, the right one on a tie
    lone = (left == size) & (lens[seq] <= K)  # a sequence with one hash
    keep[:total] |= lone
    keep = keep[:total] & (h != top)
    return h[keep], seq[keep], (at - first[seq])[keep]


def word_hashes(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((zlib.crc32(w) for r in rows for w in r), np.uint32, int(lens.sum())), lens


class Index:
    """Sorted fingerprints of the templates with their places."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(n for n in templates if words(templates[n]))
        self.words = [words(templates[n]) for n in self.names]
        if sum(map(len, self.words)) > MAX_WORDS:
            raise ValueError("too many template words for one index; scan in several calls")
        self.number = {w: k for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.counts = [np.unique([self.number[w] for w in t], return_counts=True) for t in self.words]
        h, self.template, self.position = fingerprints(*word_hashes(self.words))
        order = np.argsort(h, kind="stable")
        self.hashes, self.template, self.position = h[order], self.template[order], self.position[order]

    def numbers(self, text: list[bytes]) -> np.ndarray:
        """The words' numbers; those of no template share the last one."""
        return np.fromiter((self.number.get(w, len(self.number)) for w in text), np.int64, len(text))

    def most(self, template: int, numbers: np.ndarray) -> int:
        """Words of the template that stand anywhere in a stretch of text, each as often as in both: no alignment matches more."""
        own, most = self.counts[template]
        found, times = np.unique(numbers, return_counts=True)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        return int(np.minimum(most[at], times)[own[at] == found].sum())

    def candidates(self, hashes: np.ndarray, lens: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Diagonals (text position minus template position) by (text, template)."""
        h, seq, at = fingerprints(hashes, lens)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        out = defaultdict(set)
        for k in np.flatnonzero(hi > lo).tolist():
            for j in range(lo[k], hi[k]):
                out[int(seq[k]), int(self.template[j])].add(int(at[k]) - int(self.position[j]))
        return {k: sorted(v) for k, v in out.items()}


def align(text: list[bytes], template: list[bytes], low: int, high: int, start: int = 0, stop: int | None = None) -> tuple[int, int, int]:
    """Most words of text[start:stop] matched in order with the text position minus the template position in [low, high]:
    (matched, first and last matched text word); of equal alignments the latest start, then the one that ends first."""
    stop = len(text) if stop is None else stop
    best = (0, 0, 0)
    width = high - low + 1
    row = [(0, 0, 0)] * width  # of the template word before: (matched, -first, -last), by diagonal
    for j, word in enumerate(template):
        new = []
        for d in range(width):
            i = j + low + d
            cell = row[d]
            if start <= i < stop and text[i] == word:
                cell = (cell[0] + 1, cell[1] if cell[0] else i, -i)
            if d + 1 < width:
                cell = max(cell, row[d + 1])  # a template word without a partner
            if d:
                cell = max(cell, new[d - 1])  # a text word without one
            new.append(cell)
        row = new
        best = max(best, max(row))
    return best[0], best[1], -best[2]


def matches(index: Index, text: list[bytes], by_template: dict[int, list[int]], least: float) -> list[tuple]:
    """(template, matched, first word, last word) of every match that covers at least ``least`` of its template.

    Of each window of diagonals the words before and behind a match are aligned again, until none reaches ``least``. A
    stretch is aligned only if it holds enough of the template's words, in whatever order."""
    out, numbers = [], index.numbers(text)
    for t, diagonals in sorted(by_template.items()):
        size, groups = len(index.words[t]), []
        for d in diagonals:
            if groups and d - groups[-1][1] <= BAND:
                groups[-1][1] = d
            else:
                groups.append([d, d])
        found: list[tuple[int, int, int]] = []  # (first, last, matched), apart from each other and in order
        for a, b in groups:
            for lo in range(a, b + 1, 4 * BAND + 1):
                low, high = lo - BAND, min(b, lo + 4 * BAND) + BAND
                start, stop, free = max(low, 0), min(high + size, len(text)), []
                for x, y, _ in found[max(bisect.bisect(found, (start,)) - 1, 0) :]:  # the words no match has taken
                    if x >= stop:
                        break
                    free.append((start, x))
                    start = max(start, y + 1)
                free.append((start, stop))
                while free:
                    start, stop = free.pop()
                    if stop - start < max(least * size, 1) or index.most(t, numbers[start:stop]) < least * size:
                        continue
                    n, first, end = align(text, index.words[t], low, high, start, stop)
                    if n and n >= least * size:
                        bisect.insort(found, (first, end, n))
                        free += [(start, first), (end + 1, stop)]
        out += [(t, n, first, end) for first, end, n in found]
    return out


def ranked(index: Index, found: list[tuple]) -> list[tuple[float, bool]]:
    """(share, best) of each match: the share of the span's words that match, and whether the match is the reading of its
    span. Matches are taken from the closest one on, by matched words over the mean of template and span (of equal ones the
    longer, then by name), and one that has more than half of its span in common with a match taken before is a runner-up:
    a notice of one license that holds every word of another's is read as the one it is."""
    close = lambda m: 2 * m[1] / (len(index.words[m[0]]) + m[3] - m[2] + 1)
    taken: list[tuple[int, int]] = []
    best = [False] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (-close(found[i]), -found[i][1], found[i][0], found[i][2])):
        _, _, a, b = found[i]
        at = bisect.bisect(taken, (a,))
        shared = max((min(b, y) - max(a, x) + 1 for x, y in taken[max(at - 2, 0) : at + 2]), default=0)
        if 2 * shared <= b - a + 1:
            bisect.insort(taken, (a, b))
            best[i] = True
    return [(m[1] / (m[3] - m[2] + 1), x) for m, x in zip(found, best, strict=True)]


def scan(docs: DataFrame, found_by: dict[str, str] | DataFrame = TEMPLATES, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: id, template, occurrence, matched_words, template_words, coverage, start, end (code points), share (of
    the span's words) and best (the reading of its span; false for a runner-up)."""
    spark = docs.sparkSession
    common.tune(spark)
    held = spark.sparkContext.broadcast(Index(templates(found_by) if isinstance(found_by, DataFrame) else found_by))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    names = [id_col, "template", "occurrence", "matched_words", "template_words", "coverage", "start", "end", "share", "best"]

    def run(batches):
        index = held.value
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = [words(t) for t in texts]
            by_doc: dict[int, dict[int, list]] = defaultdict(dict)
            for (i, t), diagonals in index.candidates(*word_hashes(cut)).items():
                by_doc[i][t] = diagonals
            out, who = [], []
            for i, found in sorted(by_doc.items()):
                spans, seen = None, defaultdict(int)
                all_of = matches(index, cut[i], found, least)
                for (t, n, first, last), (share, best) in zip(all_of, ranked(index, all_of), strict=True):
                    spans = spans or [m.span() for m in _WORD.finditer(texts[i])]
                    size = len(index.words[t])
                    out.append((index.names[t], seen[t], n, size, n / size, spans[first][0], spans[last][1], share, best))
                    seen[t] += 1
                    who.append(i)
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, template string, occurrence int, matched_words int, template_words int, coverage double, start long, end long, share double, best boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
