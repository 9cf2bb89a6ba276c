"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates are sequences of lower-case words. A template's fingerprints are hashes of
its k-word windows, of which winnowing keeps the smallest of every w in a row; short
templates keep all of them and their telling words as well. The kept fingerprints of all
templates form an inverted index (fixed size: it holds templates, not documents). Every window of a
document is looked up in it, so a document's result does not depend on its neighbours. Hits give diagonals (place in
the text minus place in the template); around each diagonal whose band holds enough of the template's words
a banded alignment counts the template words that are matched in order. The band grows with the
template, so the parts of a notice that inserted words push apart are aligned as one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_slices, word_hashes

# Notices as they are published, one entry for each.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    # the conditions also occur without the disclaimer that follows them
    "BSD-3-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
TEMPLATES["BSD-3-Clause"] = (
    TEMPLATES["BSD-3-Clause conditions"]
    + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
# Words that tell a license from its neighbours: each of them has to match at one of its places in the template.
REQUIRED = {"2", "3", "4", "apache", "mit", "nc", "noncommercial", "noderivatives", "sharealike"}

_WORD = re.compile(r"[^\W_]+")
FOUND = "doc_id bigint, license string, coverage double, n_matched bigint, n_template bigint, start_char bigint, end_char bigint"


@dataclass(frozen=True)
class Settings:
    """k words a fingerprint, winnowing window w, least half width of the band, least coverage reported.

    Templates of at most `short` words are not winnowed and are also indexed by their telling words alone.
    """

    k: int = 2
    w: int = 3
    band: int = 8
    least: float = 0.75
    short: int = 16

    def band_of(self, words: int) -> int:
        return max(self.band, words // 5)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of a sequence of word hashes."""
    if k == 1:
        return hashes
    n = max(0, len(hashes) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(3) + hashes[j : j + n])
    return h


def fingerprints(hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints of a template and their places; ties go to the rightmost. Short sequences keep their smallest."""
    h = window_hashes(hashes, k)
    if len(h) <= w:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
        return h[at], at
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(len(windows)) + (w - 1 - windows[:, ::-1].argmin(1)))
    return h[at], at


def align(words: np.ndarray, template: np.ndarray, centre: int, band: int, begin: int = 0, end: int | None = None, needed: frozenset[int] = frozenset()) -> tuple[int, int, int]:
    """Longest common subsequence of template and text within |text place - template place - centre| <= band.

    Only the text's places from begin to before end are used, and template places in needed have to match. Returns matched words and the first
    and last matched place in the text (-1 without a match). Of equal results the match that ends first and then begins last is taken.
    """
    m = len(template)
    a = max(begin, centre - band)
    b = min(len(words) if end is None else end, centre + band + m)
    if b <= a or not m:
        return 0, -1, -1
    here = words[a:b]
    n, lost = len(here), -m - 1
    table = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m):
        same = here == template[i]
        low, high = i + centre - band - a, i + centre + band + 1 - a  # the band in this row
        if low > 0:
            same[:low] = False
        if high < n:
            same[max(high, 0) :] = False
        up = table[i]
        row = np.full(n + 1, lost, np.int32) if i in needed else up.copy()
        row[1:][same] = np.maximum(row[1:][same], up[:-1][same] + 1)
        table[i + 1] = np.maximum.accumulate(row)
    best = int(table[m].max())
    if best <= 0:
        return 0, -1, -1
    j = last = int(np.flatnonzero(table[m] == best)[0])
    first, i = last, m
    while i and table[i, j] > 0:
        match = j and here[j - 1] == template[i - 1] and abs(a + j - i - centre) <= band
        if match and table[i, j] == table[i - 1, j - 1] + 1:
            first, i, j = j, i - 1, j - 1
        elif i - 1 not in needed and table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return best, a + first - 1, a + last - 1


@dataclass(frozen=True)
class Template:
    """A template's word numbers, sets of places of which one has to match (a place of each telling word, first places first), and its least
    number of matched words."""

    name: str
    words: np.ndarray
    needed: tuple[frozenset[int], ...]
    need: int
    band: int


def matches(words: np.ndarray, held: np.ndarray, template: Template, offsets: list[int]) -> list[tuple[int, int, int]]:
    """Every match of one template, from left to right: matched words, first and last place.

    held counts the text's words of the template before each place; offsets are the diagonals found, in order. Beyond a match
    the same band is searched again, then the diagonals that a later copy can have. A match that runs into a second copy is
    parted if both parts are matches.
    """
    band, m, need = template.band, len(template.words), template.need

    def best(centre: int, begin: int, end: int) -> tuple[int, int, int]:
        a, b = max(begin, centre - band), min(end, centre + band + m)
        if b <= a or held[b] - held[a] < need:  # no more words can match than the band holds of the template's
            return 0, -1, -1
        found = align(words, template.words, centre, band, begin, end, template.needed[0])
        if found[0] < need and len(template.needed) > 1 and align(words, template.words, centre, band, begin, end)[0] >= need:
            found = max((align(words, template.words, centre, band, begin, end, x) for x in template.needed[1:]), key=lambda x: x[0])
        return found if found[0] >= need else (0, -1, -1)

    out: list[tuple[int, int, int]] = []
    at, begin = 0, 0
    while at < len(offsets):
        centre = offsets[at]
        found = best(centre, begin, len(words))
        while found[0]:
            n, first, last = found
            if last - first >= m:
                for cut in offsets[bisect_right(offsets, first) : bisect_right(offsets, last)]:
                    part = best(centre, begin, cut)
                    if part[0] and best(cut, cut, len(words))[0]:
                        found = n, first, last = part
                        break
            # an earlier copy can lie before a match that begins late in the band
            earlier, until = [], first
            while (ahead := best(centre, begin, until))[0]:
                earlier.append(ahead)
                until = ahead[1]
            out += [*reversed(earlier), found]
            begin = last + 1
            # a later copy lacks at most m - need words, so its diagonals are not before this
            later = bisect_left(offsets, begin - (m - need), at)
            if later < len(offsets) and offsets[later] <= centre + band:
                centre = offsets[later]
            found = best(centre, begin, len(words))
        at = max(bisect_right(offsets, centre + template.band // 2), bisect_left(offsets, begin - (m - need)))
    return out


def can_match(words: np.ndarray, template: Template, centres: np.ndarray) -> np.ndarray:
    """Whether enough of the template's words, each as often as it stands there, lie around a centre.

    Centres (in order) of one band width are looked at together, in all places that any of their bands reach, so none that can match is lost; text that
    repeats a few words of a notice over and over is told here, before any alignment.
    """
    if not len(centres):
        return np.zeros(0, bool)
    kinds, times = np.unique(template.words, return_counts=True)
    group = centres // template.band
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    fits = np.empty(len(starts), bool)
    for i, s in enumerate(starts):
        low = int(group[s]) * template.band - template.band
        here = words[max(low, 0) : max(low + 3 * template.band + len(template.words), 0)]
        counts = np.bincount(here, minlength=int(kinds[-1]) + 1)[kinds]
        fits[i] = int(np.minimum(counts, times).sum()) >= template.need
    return np.repeat(fits, np.diff(np.r_[starts, len(centres)]))


class Index:
    """Fingerprints of all templates: hash -> (template, place)."""

    def __init__(self, templates: dict[str, str], settings: Settings) -> None:
        self.settings, self.numbers = settings, {}
        self.templates: list[Template] = []
        by_hash: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in sorted(templates.items()):
            words = [w.lower() for w in _WORD.findall(text)]
            telling = REQUIRED & set(words)
            codes = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int64)
            need = max(1, math.ceil(settings.least * len(words) - 1e-9))
            hashes = word_hashes(pa.array(words, pa.string()))
            short = len(words) <= settings.short
            t = len(self.templates)
            places = [[i for i, x in enumerate(words) if x == w] for w in sorted(telling)]
            self.templates.append(Template(name, codes, tuple(map(frozenset, product(*places))), need, settings.band_of(len(words))))
            for h, at in zip(*fingerprints(hashes, settings.k, 1 if short else settings.w)):
                by_hash[int(h)].append((t, int(at)))
            for at, w in enumerate(words):
                if short and w in telling and not w.isdigit():
                    by_hash[int(hashes[at])].append((t, at))
        self.keys = np.array(sorted(by_hash), np.uint64)
        self.entries = [by_hash[int(h)] for h in self.keys]
        self.known = pa.array(list(self.numbers), pa.string())
        self.member = np.zeros((len(self.templates), len(self.numbers) + 1), bool)  # the last number stands for all other words
        for t, template in enumerate(self.templates):
            self.member[t, template.words] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that the index holds, and where."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(self.keys, hashes)
        place[place == len(self.keys)] = 0
        at = np.flatnonzero(self.keys[place] == hashes)
        return at, place[at]

    def codes(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=self.known)
        return pc.fill_null(found, len(self.numbers)).to_numpy(zero_copy_only=False).astype(np.int64)

    def matches(self, words: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches of one text from its word numbers and its hits (place, entry), best-covering ones of overlapping ones."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for at, x in found:
            for t, place in self.entries[x]:
                diagonals[t].add(at - place)
        out = []
        for t, offsets in diagonals.items():
            template = self.templates[t]
            held = np.r_[0, np.cumsum(self.member[t][words])]
            centres = np.array(sorted(offsets))
            a, b = np.clip(centres - template.band, 0, len(words)), np.clip(centres + template.band + len(template.words), 0, len(words))
            centres = centres[held[b] - held[a] >= template.need]
            centres = centres[can_match(words, template, centres)]
            if len(centres):
                out += [(t, *x) for x in matches(words, held, template, centres.tolist())]
        return best_covering(out, self.templates)


def scanner(templates: dict[str, str], settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, settings)
        for batch in text_slices(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            flat, counts = split_words(texts)
            if not len(flat):
                continue
            hashes, codes = word_hashes(flat), index.codes(flat)
            ends = np.cumsum(counts)
            by_doc: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k in sorted({1, settings.k}):
                at, place = index.hits(window_hashes(hashes, k))
                owner = np.searchsorted(ends, at, side="right")
                inside = at + k <= ends[owner] if len(at) else np.zeros(0, bool)
                for d, a, x in zip(owner[inside].tolist(), at[inside].tolist(), place[inside].tolist()):
                    by_doc[d].append((a - int(ends[d] - counts[d]), x))
            rows: list[tuple] = []
            for d, found in by_doc.items():
                spans = index.matches(codes[ends[d] - counts[d] : ends[d]], found)
                if spans:
                    places = [m.span() for m in _WORD.finditer(texts[d])]
                    doc_id = batch.column("doc_id")[d].as_py()
                    for t, n, first, last in sorted(spans):
                        m = len(index.templates[t].words)
                        rows.append((doc_id, index.templates[t].name, n / m, n, m, places[first][0], places[last][1]))
            if rows:
                types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "license", "coverage", "n_matched", "n_template", "start_char", "end_char"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of texts, flat, and their numbers."""
    held, counts = [], []
    for text in texts:
        words = _WORD.findall(text)
        held += words
        counts.append(len(words))
    # lowered in Python, since a few letters' lower case differs between libraries; each distinct word once
    coded = pa.array(held, pa.string()).dictionary_encode()
    low = pa.array([w.lower() for w in coded.dictionary.to_pylist()], pa.string())
    return low.take(coded.indices), np.array(counts, np.int64)


def best_covering(found: list[tuple[int, int, int, int]], templates: list[Template]) -> list[tuple[int, int, int, int]]:
    """Of matches that share half of the shorter one's words, the one with most words matched less words missing."""
    by_place = sorted(found, key=lambda x: (x[2], x[3]))
    out: list[tuple[int, int, int, int]] = []
    a = 0
    while a < len(by_place):
        b, reach = a + 1, by_place[a][3]
        while b < len(by_place) and by_place[b][2] <= reach:
            reach = max(reach, by_place[b][3])
            b += 1
        kept: list[tuple[int, int, int, int]] = []
        for x in sorted(by_place[a:b], key=lambda x: (len(templates[x[0]].words) - 2 * x[1], x)):
            if not any(2 * (min(x[3], y[3]) - max(x[2], y[2]) + 1) >= min(x[3] - x[2], y[3] - y[2]) + 1 for y in kept):
                kept.append(x)
        out += kept
        a = b
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per match: doc_id, license, coverage of the template, words matched, span in characters.

    Texts without a match, null and empty texts give no rows. Repeated rows are scanned
    each; a null id is carried along. Of overlapping templates the best-covering one is reported.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scanner(templates or TEMPLATES, settings), FOUND).withColumnRenamed("doc_id", id_col)
