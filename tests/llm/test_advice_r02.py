
from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tenure.llm import ann, fingerprints, licenses, toxicity

MED = "/root/testdata/sf0.1"

APACHE = """# Copyright 2020 The Foo Authors. All rights reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
MIT = """The MIT License (MIT)

Copyright (c) 2020 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
CODE = "\n" + "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(300))


@pytest.mark.parametrize(
    "text, licence",
    [
        (APACHE + CODE, "Apache-2.0"),
        (MIT + CODE, "MIT"),
        (GPL + CODE, "GPL-3.0"),
        (CODE + MIT + CODE, "MIT"),
        ("Copyright 2020 Foo Corp. Licensed under the MIT License. See the LICENSE file in the project root.", "MIT"),
        ("Copyright 2020 The Foo Authors. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ],
)
def test_notices_in_longer_texts(text, licence):
    found = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD).scan(text)
    assert found == {licence: (pytest.approx(1.0, abs=0.05), 1)}
    assert not licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD).scan(CODE)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_windows_equal_every_run_of_words(threshold, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 40)
    templates = {"A": ["a b a b c"], "B": ["a b c d e f a b"], "C": ["b b b b", "a c a c a"]}
    scanner, rng = licenses.Scanner(templates, threshold), random.Random(1)
    for _ in range(200):
        words = [rng.choice("abcdefxy") for _ in range(rng.randint(0, 25))]
        plain = [w.encode() for w in words]
        runs = [plain[i:j] for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        best = {name: max((licenses.dice(run, t.encode().split()) for t in texts for run in runs), default=0) for name, texts in templates.items()}
        want = {name: round(score, 9) for name, score in best.items() if score >= threshold}
        assert {name: round(score, 9) for name, (score, _) in scanner.scan(" ".join(words)).items()} == want


def test_neighbours_among_many_copies(spark, monkeypatch):
    """A cell of copies is cut into slices and blocks; the result is that of brute force."""
    monkeypatch.setattr(ann, "SLICE", 50)
    monkeypatch.setattr(ann, "QUERIES", 30)
    monkeypatch.setattr(ann, "TARGET", 1.0)
    x = np.random.default_rng(3).standard_normal((900, 8)).round(3)
    x[300:700] = x[300]
    ids = [*range(890), *[889] * 10]
    x[889:] = x[889]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    groups = []
    monkeypatch.setattr(ann, "_counted", lambda r, count=ann._counted: groups.append(count(r)) or groups[-1])
    got = {}
    for r in ann.search(rows, rows.filter("vec_id >= 300 and vec_id < 420 or vec_id = 889"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert groups[0].max() >= 400 and groups[1].max() >= 100  # hot cells on both sides
    for q in [*range(300, 420), 889]:
        s = (x * x[q]).sum(axis=1)
        want = sorted((-s[i], ids[i]) for i in range(900) if ids[i] != q)[:5]
        assert [(i, v) for i, v, _ in sorted(got[q])] == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_only_copies_that_can_be_neighbours_are_compared(monkeypatch):
    x = np.repeat(np.random.default_rng(4).standard_normal((3, 4)), [5000, 3, 40], axis=0)
    ids = np.concatenate((np.arange(5000)[::-1], [7, 7, 7], np.full(40, 9)))
    kept = ann._spared(x, ids, 4)
    assert sorted(ids[kept].tolist()) == sorted([*range(8), 7, 7, 7, 9, 9, 9, 9])
    monkeypatch.setattr(ann, "PAIRS", 1000)
    monkeypatch.setattr(ann, "GATHER", 10)
    full = ann._best(x[[0, 5001]], np.array([2, 9]), x, ids, 4)
    less = ann._best(x[[0, 5001]], np.array([2, 9]), x[kept], ids[kept], 4)
    assert ids[full[1]].tolist() == ids[kept][less[1]].tolist() and full[2].tolist() == less[2].tolist()


def test_very_long_clean_texts_are_not_toxic(spark):
    """Held-out clean texts joined to 1, 2 and 4 MB; as bigger the text, the more n-grams fall on those of a small table."""
    docs, labels = spark.read.parquet(f"{MED}/documents.parquet"), spark.read.parquet(f"{MED}/labels.parquet")
    model = toxicity.train(docs, labels)
    weights = model.dense()
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").select("doc_id", "text").orderBy("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    rng = random.Random(2)
    for size in (1, 2, 4):
        for _ in range(5):
            rng.shuffle(clean)
            text = "\n\n".join(clean * 4)[: size * 1_000_000]
            assert len(text) == size * 1_000_000
            assert 1 / (1 + np.exp(-toxicity.log_odds(text, weights, model.intercept))) < toxicity.THRESHOLD


@pytest.mark.parametrize("true", [0.6, 0.8])
def test_sketch_errors_at_the_size_of_the_query(true):
    """200 pairs of texts of 2,000 words with a common start: errors as the README says."""
    k, n, rng = fingerprints.K, 2000, np.random.default_rng(6)
    common = round(2 * true / (1 + true) * n)
    off, counts = [], []
    for _ in range(200):
        word = rng.integers(1 << 40, size=2 * n).astype(str).tolist()
        a, b = word[:n], word[:common] + word[n : 2 * n - common]
        sa, sb = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        x, y = (fingerprints.sketch(" ".join(t)) for t in (a, b))
        assert len(x) == k
        off.append(fingerprints.resemblance(x, y) - len(sa & sb) / len(sa | sb))
        counts.append(fingerprints.distinct_shingles(x) / len(sa) - 1)
    error = (true * (1 - true) / k) ** 0.5
    assert abs(np.mean(off)) < 0.3 * error and 0.8 * error < np.std(off) < 1.2 * error
    assert (np.abs(off) < 2 * error).mean() > 0.9
    assert abs(np.mean(counts)) < 0.04 and 0.1 < np.std(counts) < 0.16
