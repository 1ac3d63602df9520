"""Licence notices by the Dice coefficient over word bigrams (operator 9).

A text is normalised to lower-case words without punctuation, across its lines, so that wrapped notices are one. Runs of words
are compared with each licence template by twice the shared bigrams (as multisets) over the bigrams of both. Two bounds prune: a
run can only reach the threshold t with a template of b bigrams if it has between b t / (2 - t) and b (2 - t) / t of them, and
only if the text holds at least one of any ``floor(b (2 - 2 t) / (2 - t)) + 1`` bigrams of the template, for which those with
the longest words are taken. Runs of all these lengths are tried that begin and end with a bigram of the template: any other
run counts no less without its ends. So all three are exact.

A bigram counts in a run unless the run holds as many of its kind before it as the template has; so from one start, the shared
bigrams of all runs are one running sum, and the starts of a slice are tried together. Of a template's overlapping runs the
best is taken, and only the starts that reach into it are tried again, up to it. Then each word belongs to one match at most
over all templates: the one that shares the most bigrams, of equals the one of higher Dice. Time follows the text's length
times the template's, and memory the text's words.

Defined cases: null or empty text has no notice; one row for each text and licence found, none for texts without; of
overlapping matches that are alike in both the first counts, and then the first name; repeated rows are searched each; null ids
are kept; extra columns are ignored. A text of under two words matches nothing. Texts may have any length.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

THRESHOLD = 0.8
_WORDS = re.compile(r"[^\W_]+")

#: The texts of short licences, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a
copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""

#: Starts of runs that are tried together.
SLICE = 256

#: The notices by which common licences are named in texts, and those texts.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", APACHE_NOTICE],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", MIT],
    "isc": [ISC],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."],
    "bsd-2-clause": [f"{BSD_HEAD} {BSD_TAIL}"],
    "bsd-3-clause": [f"{BSD_HEAD} {BSD_NAME} {BSD_TAIL}"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", GPL_NOTICE],
    "unlicense": [UNLICENSE],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0."],
    "reserved": ["All rights reserved."],
}


def words_of(line: str) -> list[str]:
    return _WORDS.findall(line.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    grams: Counter
    least: int
    most: int
    anchors: tuple

    @classmethod
    def of(cls, name: str, text: str, threshold: float) -> Template:
        grams = bigrams(words_of(text))
        b = grams.total()
        spare = math.floor(b * (2 - 2 * threshold) / (2 - threshold) + 1e-9) + 1
        longest = sorted(set(grams.elements()), key=lambda g: (-max(map(len, g)), g))[:spare]
        if len(longest) < spare:
            longest = sorted(grams)
        return cls(name, grams, math.ceil(b * threshold / (2 - threshold) - 1e-9), math.floor(b * (2 - threshold) / threshold + 1e-9), tuple(sorted({max(g, key=len) for g in longest})))


class Hits:
    """The places of a template's bigrams in a text, and the best runs from them."""

    def __init__(self, at: np.ndarray, kind: np.ndarray, times: np.ndarray, t: Template, threshold: float):
        """``at``: places in order; ``kind``: which bigram each is; ``times``: how often the template has each."""
        self.at, self.b, self.most, self.threshold = at, t.grams.total(), t.most, threshold
        order = np.argsort(kind, kind="stable")
        back = np.arange(len(at)) - times[kind[order]]
        same = (back >= 0) & (kind[order][np.maximum(back, 0)] == kind[order])
        #: The place from which on a run must not begin earlier for a bigram to count in it.
        self.since = np.empty(len(at), np.int64)
        self.since[order] = np.where(same, at[order][np.maximum(back, 0)], -1)
        self.need = math.ceil(threshold * (self.b + t.least) / 2 - 1e-9)
        self.padded = np.concatenate([at, np.full(self.most, 1 << 60)]), np.concatenate([self.since, np.full(self.most, 1 << 60)])

    def best(self, first: int, last: int, limit: int = 1 << 59) -> list[tuple[float, int, int, int]]:
        """(-Dice, start, end, shared) of the best run from each of the hits ``first`` to ``last`` that reaches the threshold.

        Runs end before place ``limit``; start and end are places of words, the end exclusive.
        """
        out = []
        for k in range(first, last, SLICE):
            n = min(SLICE, last - k)
            start = self.at[k : k + n]
            reach = min(self.most, int(np.searchsorted(self.at, min(int(start[-1]) + self.most, limit)) - k))
            if reach < self.need:
                continue
            at = np.lib.stride_tricks.sliding_window_view(self.padded[0][k : k + n + reach - 1], reach)
            since = np.lib.stride_tricks.sliding_window_view(self.padded[1][k : k + n + reach - 1], reach)
            size = at - start[:, None] + 1
            shared = np.cumsum(since < start[:, None], axis=1)
            score = np.where((size <= self.most) & (at < limit), 2 * shared / (size + self.b), 0.0)
            end = score.argmax(1)
            row = np.flatnonzero(score[np.arange(n), end] >= self.threshold)
            out += [(-float(score[i, e]), int(start[i]), int(at[i, e]) + 2, int(shared[i, e])) for i, e in zip(row.tolist(), end[row].tolist(), strict=True)]
        return out

    def matches(self) -> list[tuple[float, int, int, int]]:
        """The best runs that don't overlap, best first."""
        waiting = self.best(0, len(self.at))
        heapq.heapify(waiting)
        taken: list[tuple[int, int]] = []
        out = []
        while waiting:
            run = heapq.heappop(waiting)
            _, a, b, _ = run
            k = bisect.bisect(taken, (a, 1 << 60))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue  # what begins before a taken run has been tried again, up to it
            taken.insert(k, (a, b))
            out.append(run)
            first, last = np.searchsorted(self.at, [max(a - self.most, taken[k - 1][1] if k else 0), a])
            for again in self.best(int(first), int(last), a - 1):
                heapq.heappush(waiting, again)
        return out


class Scanner:
    """Matches of all templates in whole texts."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [Template.of(name, text, threshold) for name, texts in templates.items() for text in texts]
        anchors = sorted({a for t in self.templates for a in t.anchors})
        self.anchor = re.compile("|".join(map(re.escape, anchors)))
        words = sorted({w for t in self.templates for g in t.grams for w in g})
        self.number = {w: i for i, w in enumerate(words)}
        code = lambda g: self.number[g[0]] * len(words) + self.number[g[1]]
        self.codes = []
        for t in self.templates:
            codes, times = zip(*sorted((code(g), n) for g, n in t.grams.items()), strict=True) if t.grams else ((), ())
            self.codes.append((np.array(codes, np.int64), np.array(times, np.int64)))

    def found(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, start, end) of the matches in a text, of which none overlaps another."""
        present = set(words)
        numbers = np.array([self.number.get(w, -1) for w in words], np.int64)
        grams = np.where((numbers[:-1] >= 0) & (numbers[1:] >= 0), numbers[:-1] * len(self.number) + numbers[1:], -1)
        every = []
        for t, (codes, times) in zip(self.templates, self.codes, strict=True):
            if len(grams) < t.least or not any(a in present for a in t.anchors):
                continue
            kind = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
            at = np.flatnonzero(codes[kind] == grams)
            if len(at):
                every += [(-shared, d, a, b, t.name) for d, a, b, shared in Hits(at, kind[at], times, t, self.threshold).matches()]
        taken: list[tuple[int, int]] = []
        out = []
        for _, d, a, b, name in sorted(every):
            k = bisect.bisect(taken, (a, 1 << 60))
            if not ((k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b)):
                taken.insert(k, (a, b))
                out.append((name, -d, a, b))
        return out

    def scan(self, text: str) -> list[tuple[str, int, float]]:
        """(licence, matches, best Dice) of a text, by name, in runs of any length across line ends."""
        if not self.anchor.search(low := text.lower()):
            return []
        best: dict[str, list] = {}
        for name, d, _, _ in self.found(words_of(low)):
            x = best.setdefault(name, [0, 0.0])
            x[0] += 1
            x[1] = max(x[1], d)
        return [(name, n, round(d, 9)) for name, (n, d) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_matches, dice: a row for each licence whose notice a text holds."""
    return per_text(docs, "license string, n_matches long, dice double", lambda: Scanner(templates, threshold).scan, id_col, text_col, many=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
