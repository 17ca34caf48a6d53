"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is judged by its words. Lines are normalised (lower case, "licence" and
"licences" spelt with s, copyright lines and other characters than letters and
digits dropped, version numbers kept as words) and their words joined to one
sequence. Every run of consecutive words is a candidate, wherever in a line it
starts or ends and over any number of lines. The Dice coefficient of a run and a
template is twice the number of word bigrams they share (with repeats) over the
number of bigrams of both, where a start and an end mark belong to the words. A
template can reach ``threshold`` only if the run's number of bigrams n and its own
m satisfy 2 * min(n, m) >= threshold * (n + m); other sizes are never compared.

Two more cuts lose nothing. A run is more like a template without a first or last
word that brings it none of the template's bigrams, so runs start and end only at
words that do, and a run that is cut so is never reported (the shorter one goes
before it, or what excludes the shorter one excludes it). And a run needs so many of
the template's bigrams that only stretches of the text where they lie that densely
are looked at.

Everything is decided where a row is read; the templates are a fixed short list
(or the caller's, of a stated size). Nothing is shuffled, so a hot source stays
spread as the input is.

Defined results: null and empty texts hold no licence; of runs that share a word,
the one with the larger coefficient is reported (then the longer, then the first),
so a line can hold several notices; of templates equally like, the first in the list; repeated rows each give their
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, whole_text

THRESHOLD = 0.8

# Usual notices and short licence texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
]

# The GNU family: (identifier, name, version). Texts of the family differ by a word or
# two, so each needs its own or is taken for its neighbour.
_GNU = [
    *(("GPL-" + v + ".0", "General Public License", v) for v in "123"),
    ("LGPL-2.0", "Library General Public License", "2"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
    ("AGPL-3.0", "Affero General Public License", "3"),
]
_GNU_HEADERS = [
    "the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version.",
    "the GNU {name} as published by the Free Software Foundation; version {v} of the License.",
    "the GNU {name}, version {v}, as published by the Free Software Foundation.",
    "version {v} of the GNU {name} as published by the Free Software Foundation.",
]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives"}
_CC |= {"BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_SHORT = [
    ("MIT", "the MIT License"),
    ("ISC", "the ISC License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-1.1", "the Apache License, Version 1.1"),
    *((f"BSD-{n}-Clause", f"the BSD {n}-Clause License") for n in "234"),
    ("MPL-1.1", "the Mozilla Public License, version 1.1"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    *((i, f"the GNU {name}, {w} {v}") for i, name, v in _GNU for w in ("version", "v")),
    *((i, f"the GNU {name}, version {v} or later") for i, name, v in _GNU),
    *((f"CC-{k}-{v}", f"CC {k} {v}") for k in _CC for v in _CC_VERSIONS),
    *((f"CC-{k}-{v}", f"the Creative Commons {name} {v} {kind} License") for k, name in _CC.items() for v, kind in _CC_VERSIONS.items()),
]
_SPDX = ["MIT", "MIT-0", "ISC", "0BSD", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-1.1", "MPL-2.0"]
_SPDX += ["Unlicense", "CC0-1.0", "Zlib", "BSL-1.0", "EPL-1.0", "EPL-2.0", *(f"CC-{k}-{v}" for k in _CC for v in _CC_VERSIONS)]

# Bodies
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
    "software developed by the University of California, Berkeley and its contributors. "
)
_BSD_NAMES = (
    "Neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE {holders} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {holder} OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_HOLDER = {"holders": "COPYRIGHT HOLDERS", "holder": "COPYRIGHT HOLDER"}
_REGENTS = {"holders": "REGENTS", "holder": "REGENTS"}

TEMPLATES += [
    *((i, f"{form} {text}.") for i, text in _SHORT for form in ("Licensed under", "Released under", "Distributed under", "This work is licensed under")),
    *((i, f"SPDX-License-Identifier: {i}") for i in _SPDX),
    *((i, f"SPDX-License-Identifier: {i}{end}") for i, _, _ in _GNU for end in ("", "-only", "-or-later")),
    *(
        (i, f"This {what} is free software; you can redistribute it and/or modify it under the terms of {form.format(name=name, v=v)}")
        for i, name, v in _GNU
        for form in _GNU_HEADERS
        for what in ("program", "library")
    ),
    ("MIT", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}"),
    ("MIT-0", f"{_GRANT}. {_MIT_DISCLAIMER}"),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER.format(**_HOLDER)),
    ("BSD-3-Clause", _BSD + "3. " + _BSD_NAMES.format(holder="copyright holder") + _BSD_DISCLAIMER.format(**_HOLDER)),
    ("BSD-4-Clause", _BSD + "3. " + _BSD_ADVERTISING + "4. " + _BSD_NAMES.format(holder="University") + _BSD_DISCLAIMER.format(**_REGENTS)),
]

_TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")
_SPELT = {"licence": "license", "licences": "licenses", "licenced": "licensed"}
_COPYRIGHT = re.compile(r"^\s*(?:copyright|\(c\)|©)\s", re.I)
FOUND = "doc_id long, license string, first_line long, n_lines long, dice double"


def words_of(line: str) -> list[str]:
    if _COPYRIGHT.match(line):
        return []
    return [_SPELT.get(w, w) for w in _TOKEN.findall(line.lower())]


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(["", *words], [*words, ""])) if words else Counter()


def dice(a: Counter, b: Counter) -> float:
    n = sum(a.values()) + sum(b.values())
    return 2 * sum(min(k, b[g]) for g, k in a.items()) / n if n else 0.0


@dataclass
class Scanner:
    templates: list[tuple[str, str]]
    threshold: float

    def __post_init__(self):
        self.bags = [(name, bigrams(words_of(text))) for name, text in self.templates]
        self.sizes = [sum(bag.values()) for _, bag in self.bags]
        # bounds of a run's bigrams, and the least it must share, by template
        low = self.threshold / (2 - self.threshold)
        self.least = [max(2, math.ceil(m * low - 1e-9)) for m in self.sizes]
        self.most = [math.floor(m / low + 1e-9) if m else 0 for m in self.sizes]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for t, (_, bag) in enumerate(self.bags):
            for g in bag:
                if g[0] and g[1]:
                    self.holders.setdefault(g, []).append(t)
        # templates of one word have no bigram between marks
        self.single: dict[str, list[int]] = {}
        for t, (_, bag) in enumerate(self.bags):
            if self.least[t] <= 2 and self.sizes[t]:
                for w in {w for g in bag for w in g if w}:
                    self.single.setdefault(w, []).append(t)

    def stretches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, last word) of the stretches that hold all its runs."""
        places: dict[int, list[int]] = {}
        holders = self.holders
        for at, g in enumerate(zip(words, words[1:])):
            if g in holders:
                for t in holders[g]:
                    places.setdefault(t, []).append(at)
        for t, held in places.items():
            # besides the marks a run of at most ``most`` bigrams needs ``need`` between its words
            need, reach = self.least[t] - 2, self.most[t] - 2
            if need < 1:
                continue
            first = last = None
            for a, b in zip(held, held[need - 1 :]):
                if b - a >= reach:
                    continue
                # a run over these reaches from the words before b back to those after a
                lo, hi = max(0, b + 1 - reach), min(len(words) - 1, a + reach)
                if first is None or lo > last + 1:
                    if first is not None:
                        yield t, first, last
                    first, last = lo, hi
                else:
                    last = max(last, hi)
            if first is not None:
                yield t, first, last
        if self.single:
            for at, w in enumerate(words):
                for t in self.single.get(w, ()):
                    yield t, max(0, at - self.most[t]), min(len(words) - 1, at + self.most[t])

    def runs(self, words: list[str], t: int, lo: int, hi: int) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first word, last word) of the runs within a stretch that match."""
        bag, m = self.bags[t][1], self.sizes[t]
        own = [False] + [(words[i - 1], words[i]) in bag for i in range(lo + 1, hi + 1)] + [False]
        closes = [(words[i], "") in bag for i in range(lo, hi + 1)]
        for i in range(lo, hi + 1):
            opens = ("", words[i]) in bag
            if not (opens or own[i - lo + 1]):
                continue
            shared, left = int(opens), {}
            for j in range(i, min(hi, i + self.most[t] - 2) + 1):
                brings = closes[j - lo]
                if j > i and own[j - lo]:
                    g = (words[j - 1], words[j])
                    rest = left.get(g, bag[g])
                    left[g] = rest - 1
                    brings = True
                    shared += rest > 0
                if brings:
                    value = 2 * (shared + closes[j - lo]) / (j - i + 2 + m)
                    if value >= self.threshold - 1e-12:
                        yield value, i, j

    def scan(self, text: str) -> Iterator[tuple[str, int, int, float]]:
        """(licence, first line, lines, coefficient) of the runs that match."""
        words: list[str] = []
        starts: list[int] = []  # number of words before each line
        for line in text.split("\n"):
            starts.append(len(words))
            words += words_of(line)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for t, lo, hi in self.stretches(words):
            for value, i, j in self.runs(words, t, lo, hi):
                found[i, j] = max(found.get((i, j), (0.0, 0)), (value, -t))
        taken: list[tuple[int, int]] = []
        ordered = sorted((-value, i - j, i, -template) for (i, j), (value, template) in found.items())
        for value, span, first, template in ordered:
            last = first - span
            place = bisect_left(taken, (first, last))
            if (place == 0 or taken[place - 1][1] < first) and (place == len(taken) or taken[place][0] > last):
                taken.insert(place, (first, last))
                top, end = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
                yield self.bags[template][0], top, end - top + 1, -value


def licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, first_line, n_lines, dice): one row per licence notice."""
    chosen = TEMPLATES if templates is None else templates

    def judge(parts):
        scanner = Scanner(chosen, threshold)
        for part in parts:
            out = [(d, *m) for d, t in zip(part.column(0).to_pylist(), part.column(1)) for m in scanner.scan(t.as_py())]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            names = ["doc_id", "license", "first_line", "n_lines", "dice"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(judge, FOUND)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))
