"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import _base as B
from . import spans

#: Texts of public licence notices, by identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Tokens of a fingerprint and fingerprints of a window: four tokens in a row always share one.
GRAM, WINDOW = 3, 2
#: Templates up to this length have a fingerprint for every two tokens, and need several hits near one diagonal.
SHORT, PAIR = 24, 2
BAND = 8
CHUNK = re.compile(r"\S+")


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window; of equal ones the rightmost."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def align(doc: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment within a band about doc = template + shift: matches, start and end token in doc.

    A match scores 2, a substitution, insertion or deletion costs 1.
    """
    width = 2 * band + 1
    score, best = [0] * (width + 1), (0, 0, 0, 0)
    info = [(0, -1)] * (width + 1)  # matches so far, start
    n = len(doc)
    for j, t in enumerate(template.tolist()):
        new, new_info = [0] * (width + 1), [(0, -1)] * (width + 1)
        for k in range(width):
            i = j + shift + k - band
            if not 0 <= i < n:
                continue
            same = doc[i] == t
            s, inf = score[k] + (2 if same else -1), info[k]  # diagonal: same k
            if score[k + 1] - 1 > s:
                s, inf, same = score[k + 1] - 1, info[k + 1], False  # template token without one in doc
            if k and new[k - 1] - 1 > s:
                s, inf, same = new[k - 1] - 1, new_info[k - 1], False
            if s > 0:
                m, a = inf if inf[1] >= 0 else (0, i)
                new[k], new_info[k] = s, (m + same, a)
                if (s, m + same) > best[:2]:
                    best = (s, m + int(same), a, i + 1)
        score, info = new, new_info
    return best[1:]


def band_of(template: np.ndarray) -> int:
    """Half-width of the alignment's band: less than half of a short template, so that repeats keep apart."""
    return min(BAND, max(1, (len(template) - 1) // 2))


class LicenseIndex:
    """Inverted indexes from fingerprints to (template, token position), of long and of short templates."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = 0.8):
        texts = [(name, spans.tokens(text)) for name, text in templates]
        self.templates = [(name, t) for name, t in texts if t]
        self.vocab = spans.Vocabulary([t for _, t in self.templates])
        self.numbers = [np.array([self.vocab.ids[t] for t in toks], np.int64) for _, toks in self.templates]
        self.coverage = coverage
        self.indexes = []  # size of a fingerprint, fingerprints of a window, places by hash, hashes
        for size, window, own in ((GRAM, WINDOW, False), (PAIR, 1, True)):
            places: dict[int, list[tuple[int, int]]] = {}
            for k, n in enumerate(self.numbers):
                if (len(n) <= SHORT) is own:
                    h = self.grams(n, min(size, len(n)))
                    for at in winnow(h, window):
                        places.setdefault(int(h[at]), []).append((k, int(at)))
            self.indexes.append((size, window, places, np.array(sorted(places), np.uint64)))
        self.single = {int(n[0]) for n in self.numbers if len(n) == 1}

    def votes(self, k: int) -> int:
        """Distinct fingerprints that a passage of sufficient coverage shares with the template at least.

        A short template loses two of its pairs for each token that is missing; half of what remains allows for
        tokens put in between.
        """
        n = len(self.numbers[k])
        if n > SHORT:
            return 1
        return max(1, (2 * int(np.ceil(self.coverage * n - 1e-9)) - n) // 2)

    def grams(self, n: np.ndarray, size: int = GRAM) -> np.ndarray:
        if len(n) < size:
            return np.empty(0, np.uint64)
        h = np.full(len(n) - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ self.vocab.codes[n[k : len(n) - size + 1 + k]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    def find(self, texts: list[str | None], coverage: float) -> Iterator[list[tuple]]:
        """For each text its licences: name, coverage, matched tokens, start and end character."""
        for lo, hi in spans.batches(texts):
            docs = self.vocab.number(texts[lo:hi])
            flat, starts = spans.joined(docs, GRAM + WINDOW)
            hits: dict[int, set[tuple[int, int, int]]] = {}
            for size, window, places, keys in self.indexes:
                sizes = [size, 1] if size == PAIR and self.single else [size]
                for own in sizes if len(keys) else ():
                    h = self.grams(flat, own)
                    at = winnow(h, window) if window > 1 else np.arange(len(h))
                    at = at[flat[at] > 0]
                    slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                    for p in at[keys[slot] == h[at]].tolist():
                        d = int(np.searchsorted(starts, p, "right")) - 1
                        for k, q in places[int(h[p])]:
                            hits.setdefault(d, set()).add((k, p - int(starts[d]) - q, q))
            for d, doc in enumerate(docs):
                yield self._report(texts[lo + d], doc, hits[d], coverage) if d in hits else []

    def _diagonals(self, hits: set[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
        """Template and shift of each diagonal to align about: with enough votes in its band, none within half a band of the last."""
        by: dict[int, list[tuple[int, int]]] = {}
        for k, shift, q in hits:
            by.setdefault(k, []).append((shift, q))
        for k, own in sorted(by.items()):
            own.sort()
            band, need, last, lo, hi = band_of(self.numbers[k]), self.votes(k), None, 0, 0
            for shift, _ in own:
                while own[lo][0] < shift - band:
                    lo += 1
                while hi < len(own) and own[hi][0] <= shift + band:
                    hi += 1
                if (last is None or shift - last > band // 2) and (need == 1 or len({q for _, q in own[lo:hi]}) >= need):
                    last = shift
                    yield k, shift

    def _report(self, text: str, doc: np.ndarray, hits: set[tuple[int, int, int]], coverage: float) -> list[tuple]:
        found = []
        for k, shift in self._diagonals(hits):
            matched, a, b = align(doc, self.numbers[k], shift, band_of(self.numbers[k]))
            if matched and matched >= coverage * len(self.numbers[k]):
                found.append((matched, matched / len(self.numbers[k]), self.templates[k][0], a, b))
        chosen: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
            if all(x[4] <= y[3] or x[3] >= y[4] for y in chosen):
                chosen.append(x)
        at = [m.span() for m in CHUNK.finditer(text) if spans.normal(m[0])]
        return [(name, c, m, at[a][0], at[b - 1][1]) for m, c, name, a, b in sorted(chosen, key=lambda x: x[3])]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched, start_char, end_char: every licence passage of every document.

    A passage counts if `coverage` of a template's tokens match in order. Of overlapping passages the one
    with most matched tokens stays; ties go to the larger coverage, then to the first name. Null and empty
    texts have none; repeated rows give repeated results; other columns are ignored. One pass without a
    shuffle; the index grows with the templates only.
    """
    index = LicenseIndex(templates, coverage)

    def run(texts: list[str | None]) -> tuple[list[int], pd.DataFrame]:
        found = [(i, x) for i, own in enumerate(index.find(texts, coverage)) for x in own]
        return [i for i, _ in found], pd.DataFrame([x for _, x in found], columns=["license", "coverage", "matched", "start_char", "end_char"])

    return B.beside(docs, [id_col], [text_col], run, "license string, coverage double, matched long, start_char long, end_char long", 1_000)
