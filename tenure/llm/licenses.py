"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates.

Text is lower-cased and everything but a-z, 0-9 becomes a blank. Every run of consecutive words is a window
(so every line, paragraph and the whole text is one): a notice counts wherever it stands, in a comment, on
a line with other words or before code. With n and m bigrams (repeats included), Dice = 2 |common| / (n + m)
with |common| <= min(n, m), so a window that reaches the threshold t has at least t m / (2 - t) bigrams of
the template and at most (2 - t) m / t in all. Only places that dense in a template's bigrams are
searched; there the best window from each start is found exactly.

Defined cases: null and empty texts, and texts under two words, match nothing; of overlapping windows of a licence
the best counts, and equal windows of a document count once; ties between templates are all reported;
repeated rows are reported repeatedly.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8
CHUNK = 1 << 19  # starts x window ends looked at together
# Fixed: notices and short texts of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: list[bytes], b: list[bytes]) -> float:
    """Dice coefficient of two word lists by their bigrams, repeats included; 0 below two words."""
    n = len(a) + len(b) - 2
    return 2 * sum((_bigrams(a) & _bigrams(b)).values()) / n if len(a) > 1 and len(b) > 1 else 0.0


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


class Scanner:
    """Templates as rows over the bigrams that occur in any of them, ready to be compared."""

    def __init__(self, templates: dict[str, list[str]], threshold: float) -> None:
        rows = [(name, normalised(t).split()) for name, texts in templates.items() for t in texts]
        rows = [(name, _bigrams(words)) for name, words in rows if len(words) > 1]
        self.threshold = threshold
        self.names = [name for name, _ in rows]
        self.sizes = np.array([g.total() for _, g in rows], dtype=np.int64)
        self.need = np.maximum(np.ceil(threshold * self.sizes / (2 - threshold) - 1e-9), 1).astype(np.int64)
        self.most = np.floor((2 - threshold) * self.sizes / threshold + 1e-9).astype(np.int64)
        grams = sorted({g for _, counts in rows for g in counts})
        self.words = {w: i for i, w in enumerate(sorted({w for g in grams for w in g}))}
        self.none = len(self.words)
        # Number of each pair of words: its bigram, or -1.
        self.pairs = np.full((self.none + 1, self.none + 1), -1, dtype=np.int32)
        for i, (x, y) in enumerate(grams):
            self.pairs[self.words[x], self.words[y]] = i
        self.times = np.array([[counts[g] for _, counts in rows] for g in grams], dtype=np.int64).reshape(len(grams), len(rows))

    def windows(self, gram: np.ndarray, at: np.ndarray, which: int):
        """(start, end, Dice) of the best window from each start that reaches the threshold, ends included.

        ``gram`` and ``at`` are the template's bigrams in the text and their places. The best window begins and ends
        with one: without the others at its ends it would score more.
        """
        m, need, most = int(self.sizes[which]), int(self.need[which]), int(self.most[which])
        if len(at) < need:
            return
        starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < most)
        if not len(starts):
            return
        # A bigram that the template has c times counts in a window unless c equal ones precede it there.
        order = np.argsort(gram, kind="stable")
        place = np.arange(len(gram)) - np.searchsorted(gram[order], gram[order], side="left")
        times = self.times[gram[order], which]
        before = np.full(len(gram), -1, dtype=np.int64)
        late = np.flatnonzero(place >= times)
        before[order[late]] = order[late - times[late]]
        steps = np.arange(int((np.searchsorted(at, at[starts] + most) - starts).max()))
        size = max(1, CHUNK // len(steps))
        for first in (starts[i : i + size, None] for i in range(0, len(starts), size)):
            last = np.minimum(first + steps, len(at) - 1)
            inside = first + steps < len(at)
            common = np.cumsum((before[last] < first) & inside, axis=1)
            n = at[last] - at[first] + 1
            score = np.where(inside & (2 * common >= self.threshold * (n + m)), 2 * common / (n + m), 0.0)
            best = score.argmax(axis=1)
            score = score[np.arange(len(best)), best]
            for i in np.flatnonzero(score):
                yield int(at[first[i, 0]]), int(at[last[i, best[i]]]), float(score[i])

    def scan(self, text: str | None) -> dict[str, tuple[float, int]]:
        """licence -> (best Dice, separate windows that reach the threshold)."""
        words = normalised(text).split()
        if len(words) < 2 or not self.names:
            return {}
        number = np.fromiter(map(self.words.get, words, repeat(self.none)), dtype=np.int32, count=len(words))
        gram = self.pairs[number[:-1], number[1:]]
        at = np.flatnonzero(gram >= 0)
        if len(at) < self.need.min():
            return {}
        gram = gram[at]
        many = np.bincount(gram, minlength=len(self.times)) @ (self.times > 0)
        places: dict[str, list] = {}
        for which in np.flatnonzero(many >= self.need):
            mine = self.times[gram, which] > 0
            places.setdefault(self.names[which], []).extend(self.windows(gram[mine], at[mine], which))
        return {name: _separate(words, found) for name, found in places.items() if found}


def _separate(words: list[bytes], found: list[tuple[int, int, float]]) -> tuple[float, int]:
    """(best Dice, distinct windows): the best window, the best of those that share no word with it, and so on."""
    found.sort(key=lambda w: (-w[2], w[0] - w[1], w[0]))
    taken: list[tuple[int, int]] = []
    seen = set()
    for start, end, _ in found:
        i = bisect_left(taken, (start, end))
        # Bigram ``end`` covers the words up to end + 1.
        if (i and taken[i - 1][1] + 1 >= start) or (i < len(taken) and taken[i][0] <= end + 1):
            continue
        insort(taken, (start, end))
        seen.add(b" ".join(words[start : end + 2]))
    return found[0][2], len(seen)


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, segments): a row for each licence that a document's segments match."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            rows = [(i, name, score, n) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for name, (score, n) in sorted(scanner.scan(text).items())]
            ids, names, scores, times = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "licence": pa.array(names, pa.string()), "dice": pa.array(scores, pa.float64()), "segments": pa.array(times, pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, dice double, segments int")
