"""Licence scans (operator 6).

Templates are word sequences (lower-cased letter and digit runs). Every run of GRAM words of a template is hashed by its
word numbers and winnowed: of each WINDOW neighbouring runs the least hash is kept, with its place, in an inverted index.
A text's runs are looked up in the index, so any GRAM + WINDOW - 1 words shared with a template are found. Hits that go on in
both, with at most GAP words put in between, are chained to a candidate; a banded alignment of the whole template
against the text around it, as wide as the chain's diagonals are apart, gives the matched words, coverage and spans.
Candidates of at least `min_coverage` are reported.

Defined results: a null or empty text reports nothing; a text with several notices gives a row for each; a notice that is
repeated gives a row each time; ties between templates are all reported; repeated rows are reported alike; texts of any
length are scanned whole; a null doc_id is carried; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

GRAM = 3
WINDOW = 2
MIN_COVERAGE = 0.8
BAND = 6
GAP = 60
SCHEMA = "doc_id long, license string, coverage double, n_matched long, n_template long, start long, end long, spans array<struct<start:long,end:long>>"

# Notices that texts carry, as commonly worded, and the warranty paragraphs of the licences that are given whole.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "bsd-clauses": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.""",
    "bsd-warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
        IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "gpl-3.0-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\W_]+")


class Index:
    """Winnowed fingerprints of templates, by run of GRAM word numbers."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = sorted(templates)
        self.number: dict[str, int] = {}
        words = [[self.number.setdefault(w, len(self.number)) for w in _WORD.findall(templates[k].lower())] for k in self.names]
        self.words = [np.array(w, np.int64) for w in words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            codes = self.codes(w)
            mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
            kept = {min(range(i, min(i + WINDOW, len(mixed))), key=lambda j: (mixed[j], -j)) for i in range(max(1, len(mixed) - WINDOW + 1))} if mixed else set()
            for i in sorted(kept):
                self.places[int(codes[i])].append((t, i))
        self.known = np.sort(np.fromiter(self.places, np.int64, len(self.places)))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """One number for each run of GRAM words; -1 where a word is in no template."""
        n = len(ids) - GRAM + 1
        if n < 1:
            return np.zeros(0, np.int64)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            part = ids[k : k + n]
            out, ok = out * len(self.number) + part, ok & (part >= 0)
        return np.where(ok, out, -1)


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int, begin: int = 0) -> list[tuple[int, int]]:
    """Matched (template place, text place) pairs of the best alignment within `band` of the diagonal text = template + shift, from text place `begin` on."""
    width, n = 2 * band + 1, len(template)
    best = np.zeros((n + 1, width), np.int32)
    for i in range(1, n + 1):
        at = i - 1 + shift + np.arange(-band, band + 1)  # the text word at each offset of the band
        inside = (at >= begin) & (at < len(words))
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == template[i - 1])
        row = np.where(same, best[i - 1] + 1, 0)
        row = np.maximum(row, np.append(best[i - 1][1:], 0))  # a template word left out
        best[i] = np.maximum.accumulate(row)  # text words left out
    pairs, i, j = [], n, width - 1
    while i and best[i][j]:
        if j and best[i][j - 1] == best[i][j]:
            j -= 1
            continue
        at = i - 1 + shift + j - band
        if begin <= at < len(words) and words[at] == template[i - 1] and best[i][j] == best[i - 1][j] + 1:
            pairs.append((i - 1, at))
            i -= 1
        else:
            i, j = i - 1, j + 1
    return pairs[::-1]


def chains(places: list[tuple[int, int]], gap: int = GAP) -> list[list[tuple[int, int]]]:
    """Hits (text place, template place), in the order of the text, as chains that go on in both.

    A hit joins the chain that is furthest on in the template, of those that it can go on.
    """
    out: list[list[tuple[int, int]]] = []
    open_chains: list[list[tuple[int, int]]] = []
    top = max((place for _, place in places), default=0)
    for at, place in sorted(places):
        open_chains = [c for c in open_chains if at - c[-1][0] <= gap + top - c[-1][1]]
        fits = [c for c in open_chains if c[-1][1] < place and 0 < at - c[-1][0] <= gap + place - c[-1][1]]
        if fits:
            max(fits, key=lambda c: c[-1][1]).append((at, place))
        else:
            open_chains.append([(at, place)])
            out.append(open_chains[-1])
    return out


def scan(text: str | None, index: Index, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> list[tuple]:
    """(license, coverage, matched words, template words, start, end, spans) of each notice in a text, in code points."""
    lowered = text or ""
    ids = np.fromiter((index.number.get(w.lower(), -1) for w in _WORD.findall(lowered)), np.int64)
    codes = index.codes(ids)
    hit = np.flatnonzero(np.isin(codes, index.known) & (codes >= 0))
    if not len(hit):
        return []
    where = [m.span() for m in _WORD.finditer(lowered)]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in hit:
        for t, place in index.places[int(codes[at])]:
            hits[t].append((int(at), place))
    found = []
    for t, places in sorted(hits.items()):
        template, begin = index.words[t], 0
        for chain in chains(places):
            diagonals = [at - place for at, place in chain]
            low, high = min(diagonals), max(diagonals)
            centre, reach = (low + high) // 2, (high - low + 1) // 2 + band + len(template) // 20
            pairs = align(template, ids, centre, reach, begin if chain[0][0] >= begin else 0)
            if len(pairs) < min_coverage * len(template):
                continue
            begin = pairs[-1][1] + 1  # the next notice of this sort starts behind this one, unless its hits do not
            places, spans = [at for _, at in pairs], []
            for at in places:
                if spans and at == spans[-1][1] + 1:
                    spans[-1][1] = at
                else:
                    spans.append([at, at])
            cut = [{"start": where[a][0], "end": where[b][1]} for a, b in spans]
            row = (index.names[t], len(pairs) / len(template), len(pairs), len(template), cut[0]["start"], cut[-1]["end"], cut)
            if not (found and found[-1][0] == row[0] and found[-1][4] < row[5] and row[4] < found[-1][5]):
                found.append(row)
            elif row[2] > found[-1][2]:
                found[-1] = row
    return found


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, coverage, n_matched, n_template, start, end, spans (code point offsets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates)
        names = ["doc_id", "license", "coverage", "n_matched", "n_template", "start", "end", "spans"]
        for pdf in batches:
            rows = [(doc, *row) for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True) for row in scan(text if isinstance(text, str) else None, index, min_coverage)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(run, SCHEMA)
