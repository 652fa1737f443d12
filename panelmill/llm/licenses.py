"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and texts of public licenses (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "BSD-2-Clause-terms": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC-terms": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-terms": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "Public-domain": "This is free and unencumbered software released into the public domain.",
}


def _gnu(name: str, program: str, version: str) -> str:
    """The notice that the GNU licenses ask for at the head of a file."""
    return (
        f"{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        f"Foundation; either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        f"GNU {name} for more details. You should have received a copy of the GNU {name} along with this program.")


_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
TEMPLATES |= {
    "0BSD-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_DISCLAIMER,
    "AGPL-3.0-or-later-header": _gnu("Affero General Public License", "This program", "3"),
    "BSD-2-Clause-text": TEMPLATES["BSD-2-Clause-terms"] + " " + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": (
        TEMPLATES["BSD-2-Clause-terms"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER),
    "GPL-2.0-or-later-header": _gnu("General Public License", "This program", "2"),
    "GPL-3.0-or-later-header": _gnu("General Public License", "This program", "3"),
    "ISC-text": TEMPLATES["ISC-terms"] + " " + _ISC_DISCLAIMER,
    "LGPL-2.1-or-later-header": _gnu("Lesser General Public License", "This library", "2.1"),
    "LGPL-3.0-or-later-header": _gnu("Lesser General Public License", "This library", "3"),
    "MIT-text": (
        TEMPLATES["MIT-terms"] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at http://mozilla.org/MPL/2.0/."),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice "
        "may not be removed or altered from any source distribution."),
}
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
        back[i] = at[pile - 1] if pile else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), increasing in both.

    Words that occur once in a and once in b anchor; the longest increasing subsequence of the anchors
    stays; the gaps between are aligned likewise, after their common beginnings and ends. A work list
    stands for the recursion, so depth is no limit.
    """
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        many_a, many_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {w: i for i, w in enumerate(b[blo:bhi], blo) if many_b[w] == 1}
        pairs = [(i, where[a[i]]) for i in range(alo, ahi) if many_a[a[i]] == 1 and a[i] in where]
        kept = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not kept:
            continue
        found += kept
        lo_a, lo_b = alo, blo
        for i, j in [*kept, (ahi, bhi)]:
            todo.append((lo_a, i, lo_b, j))
            lo_a, lo_b = i + 1, j + 1
    return sorted(found)


class Scanner:
    """Templates prepared for scanning; least: the coverage (matched template words by all its words) that counts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = 0.8):
        self.least = least
        self.templates = {k: words_of(t) for k, t in sorted(templates.items())}
        self.sets = {k: Counter(w) for k, w in self.templates.items()}
        self.vocabulary = frozenset(w for ws in self.templates.values() for w in ws)

    def scan(self, words: list[str]) -> list[dict]:
        """Each place of each template in the words of a text, with coverage and the first and last matched word's number.

        Places of one template don't overlap: the one with most matched words stays, of equals the first.

        A template is tried wherever its words could reach the coverage: stretches of the text in which
        its words follow one another by gaps of at most twice its length, cut into windows of two and of three
        times the length, each a length after the one before. A match within twice the template's length lies whole in
        one of the wide windows; the narrow ones have fewer repeated words, which can't anchor.
        """
        if self.vocabulary.isdisjoint(words):
            return []
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.vocabulary:
                at.setdefault(w, []).append(i)
        out = []
        for name, template in self.templates.items():
            n = len(template)
            if sum(min(k, len(at.get(w, ()))) for w, k in self.sets[name].items()) < self.least * n:
                continue
            places = sorted(i for w in self.sets[name] for i in at.get(w, ()))
            places_of: list[tuple[int, int, int]] = []
            for lo, hi in self._windows(places, n):
                have = Counter(words[lo:hi])
                if sum(min(k, have[w]) for w, k in self.sets[name].items()) < self.least * n:
                    continue
                matched = align(words[lo:hi], template)
                if len(matched) >= self.least * n:
                    places_of.append((-len(matched), lo + matched[0][0], lo + matched[-1][0]))
            taken: list[tuple[int, int]] = []
            for matched_less, first, last in sorted(set(places_of)):
                if all(last < a or b < first for a, b in taken):
                    taken.append((first, last))
                    out.append({"license": name, "coverage": -matched_less / n, "matched": -matched_less, "first_word": first, "last_word": last})
        return sorted(out, key=lambda x: (-x["coverage"], -x["matched"], x["license"], x["first_word"]))

    @staticmethod
    def _windows(places: list[int], n: int) -> Iterator[tuple[int, int]]:
        start = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k] - places[k - 1] > 2 * n:
                lo, hi = places[start], places[k - 1] + 1
                for wide in (2 * n, 3 * n):
                    at = lo
                    while hi - at > wide:
                        yield at, at + wide
                        at += n
                    if wide == 2 * n or hi - lo > 2 * n:
                        yield at, hi
                start = k


FOUND = "array<struct<license: string, coverage: double, matched: int, first_word: int, last_word: int>>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
                  least: float = 0.8) -> DataFrame:
    """One row per row: doc_id, license (the best covered, null if none), coverage (0 if none), n_licenses, licenses (all places of all licenses).

    Whole texts are read, one text at a time. Null and empty texts have no license; equal
    coverage goes to the longer match, then to the lesser name; repeated rows give equal results;
    other columns don't matter. An empty table gives an empty result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches:
            found = [scanner.scan(words_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0]["license"] if f else None for f in found], pa.string()),
                 pa.array([f[0]["coverage"] if f else 0.0 for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int32()),
                 pa.array(found, pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
                                                     ("first_word", pa.int32()), ("last_word", pa.int32())])))],
                names=["doc_id", "license", "coverage", "n_licenses", "licenses"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, license string, coverage double, n_licenses int, licenses {FOUND}")
