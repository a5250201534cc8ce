"""License scans: patience alignment of texts with license templates.

Words are ``\\w+`` in lower case. Where a text shares two neighbouring words with a template, the distance between the two
places is a diagonal. Each dense diagonal makes a window of the text, as long as the template and a margin, once cut at the
neighbouring copies and once not; dense diagonals nearer than the template's length, and chains of near diagonals, make wider windows
for copies with insertions. A template of which no window shows a copy is aligned with the whole text if that holds enough of its words. Findings of windows that are wider or not cut don't count if they run over several copies. In a window, words that
occur once on both sides are anchors, the longest increasing run of them is kept, and the gaps between anchors are aligned
alike. Coverage is the share of the template's words that are aligned. A window counts from ``LEAST`` on; of windows that
overlap in the text the one with more aligned words is kept (then the higher coverage, then the name), so that a notice within an edited
longer one doesn't take its place.

Edge cases: null and empty texts and texts without any license have no findings; a template may occur any number of times in a
text; repeated rows and null ids give a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefgraph.llm.common import ship_package

LEAST = 0.8
#: Templates of this many words or more are found with other words between theirs, in at most this multiple of their length.
LEAST_SCATTERED, WIDEST = 20, 3
_WORD = re.compile(r"\w+")

# Public notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, whose second rises (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect.bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[pile], at[pile] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of aligned words, both rising."""
    found, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if here[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        for (x, y), (z, t) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if z - x > 1 and t - y > 1:
                todo.append((x + 1, z, y + 1, t))
    return sorted(found)


def _runs_over(f: dict, single: list[dict], ends: list[int]) -> bool:
    """Whether a finding meets two disjoint ones of a list sorted by ``ends``."""
    stop = None
    for g in single[bisect.bisect_right(ends, f["first"]) :]:
        if g["first"] < f["stop"] and (stop is None or g["first"] >= stop):
            if stop is not None:
                return True
            stop = g["stop"]
        elif g["first"] >= f["stop"]:
            return False
    return False


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        self.templates, self.least = {n: words(t) for n, t in templates.items()}, least
        self.seeds: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        for name, t in self.templates.items():
            for k, pair in enumerate(zip(t[:-1], t[1:], strict=True)):
                self.seeds[pair].append((name, k))
        self.first = {a for a, _ in self.seeds}
        self.distinct = {n: set(t) for n, t in self.templates.items()}
        self.vocabulary = set().union(*self.distinct.values())

    def windows(self, starts: list[int], size: int) -> dict[tuple[int, int], int]:
        """Windows (from, to) of a text by sorted diagonals, with 0 for one diagonal's, cut at the neighbouring copies, 1 for several
        diagonals', cut alike, and 2 for those that aren't cut."""
        margin, apart = max(2, size // 8), self.least * size
        near = lambda s: bisect.bisect_right(starts, s + margin) - bisect.bisect_left(starts, s - margin)
        peaks: list[int] = []
        for s, _ in sorted(Counter(starts).items(), key=lambda c: (-c[1], c[0])):
            k = bisect.bisect_left(peaks, s)
            if near(s) >= size // 4 and all(abs(s - p) > margin for p in peaks[max(0, k - 1) : k + 1]):
                peaks.insert(k, s)
        out: dict[tuple[int, int], int] = {}
        for level in (0, 1):
            for s in peaks:
                last = peaks[bisect.bisect_left(peaks, s + size) - 1] if level else s
                before, after = bisect.bisect_right(peaks, s - apart), bisect.bisect_left(peaks, last + apart)
                a = max(s - margin, min(peaks[before - 1] + size, s)) if before else s - margin
                b = min(last + size + margin, peaks[after]) if after < len(peaks) else last + size + margin
                out.setdefault((max(0, a), b), level)
        for s in peaks:
            out.setdefault((max(0, s - margin), s + size + margin), 2)
        group: list[int] = []
        for s in [*starts, None]:
            if group and (s is None or s - group[-1] > margin):
                out.setdefault((max(0, group[0] - margin), group[-1] + size + margin), 2)
                group = []
            if s is not None:
                group.append(s)
        return {w: level for w, level in out.items() if w[1] > 0}

    def scattered(self, ws: list[str], have: set[str]) -> list[dict]:
        """Templates that windows don't show since other words stand between theirs: the whole text is aligned if it holds enough of
        a template's words, and the copy must not be wider than ``WIDEST`` times the template."""
        out, there = [], self.vocabulary.intersection(ws)
        for name, own in self.distinct.items():
            template = self.templates[name]
            if name in have or len(template) < LEAST_SCATTERED or len(own & there) < self.least * len(own):
                continue
            pairs = align(ws, template)
            if len(pairs) >= self.least * len(template) and pairs[-1][0] + 1 - pairs[0][0] <= WIDEST * len(template):
                out.append({"license": name, "coverage": len(pairs) / len(template), "first": pairs[0][0], "stop": pairs[-1][0] + 1})
        return out

    def find(self, text: str | None) -> list[dict]:
        """Findings (license, coverage, first, stop: places of words) in the order of the text."""
        ws = words(text)
        diagonals: dict[str, list[int]] = defaultdict(list)
        first, seeds = self.first, self.seeds
        for i, w in enumerate(ws[:-1]):
            if w in first:
                for name, k in seeds.get((w, ws[i + 1]), ()):
                    diagonals[name].append(i - k)
        found = []
        for name, starts in diagonals.items():
            template, by_level = self.templates[name], ([], [], [])
            for (a, b), level in self.windows(sorted(starts), len(template)).items():
                pairs = align(ws[a:b], template)
                if len(pairs) >= self.least * len(template):
                    f = {"license": name, "coverage": len(pairs) / len(template), "first": a + pairs[0][0], "stop": a + pairs[-1][0] + 1}
                    by_level[level].append(f)
            copies: list[dict] = []
            for level in by_level:
                ends = [f["stop"] for f in copies]
                copies = sorted(copies + [f for f in level if not _runs_over(f, copies, ends)], key=lambda f: f["stop"])
            found += copies
        found += self.scattered(ws, {f["license"] for f in found})
        aligned = lambda f: round(f["coverage"] * len(self.templates[f["license"]]))
        found.sort(key=lambda f: (-aligned(f), -f["coverage"], f["license"], f["first"]))
        kept: list[dict] = []  # in the order of the text, without overlaps
        firsts: list[int] = []
        for f in found:
            k = bisect.bisect_left(firsts, f["first"])
            if (k == 0 or kept[k - 1]["stop"] <= f["first"]) and (k == len(kept) or f["stop"] <= kept[k]["first"]):
                firsts.insert(k, f["first"])
                kept.insert(k, f)
        return kept


def _scan(templates: dict[str, str], least: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [scanner.find(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "licenses"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, least: float = LEAST, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, licenses, n_licenses, best_license, best_coverage) for each row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scan(templates, least), f"doc_id {kind}, licenses array<struct<license: string, coverage: double, first: int, stop: int>>")
    best = F.try_element_at(F.array_sort("licenses", lambda a, b: F.when(a["coverage"] != b["coverage"], F.signum(b["coverage"] - a["coverage"]).cast("int")).otherwise(a["first"] - b["first"])), F.lit(1))
    return found.select("doc_id", "licenses", F.size("licenses").alias("n_licenses"), best["license"].alias("best_license"), best["coverage"].alias("best_coverage"))
