"""Features of the two classifiers against plain versions written from their definitions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tenure.llm import linear, quality_classifier, toxicity
from tenure.llm import words as word_module

SF = "/root/testdata/sf0.01"


def _grams(text):
    """(place, n-gram) of the lower-cased text with single blanks and one at both ends."""
    t = f" {' '.join((text or '').lower().split())} "
    return [(i, t[i : i + n]) for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)] if t.strip() else []


def _hash_of(gram, cache={}):  # noqa: B006
    """The feature of one n-gram: the last one of its own length in a text that ends with it."""
    if gram not in cache:
        chars = np.frombuffer(gram.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = 0xCBF29CE484222325
        for c in chars.tolist():
            h = (h * 0x9E3779B97F4A7C15 % 2**64) ^ c
        cache[gram] = int(word_module.mix(np.array([h], dtype=np.uint64))[0] >> np.uint64(1))
    return cache[gram]


def _starts(n, window, step):
    if n <= window:
        return [0]
    return [*range(0, n - window, step), n - window]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_toxicity_windows_equal_a_plain_version(monkeypatch, block):
    rng = random.Random(4)
    for name, value in (("BLOCK", block), ("STEP", 16), ("WINDOW", 32)):
        monkeypatch.setattr(toxicity, name, value)
    texts = [None, "", "  ", "a", "Ab", " x  y ", *("".join(rng.choice("aAbé \n") for _ in range(n)) for n in (5, 30, 31, 32, 33, 47, 48, 49, 200))]
    for text in texts:
        grams = _grams(text)
        assert {g for f in toxicity.distinct_grams(text) for g in f.tolist()} == {_hash_of(g) for _, g in grams}
        some = sorted({_hash_of(g) for _, g in grams if hash(g) % 3 and "b" in g})
        weight = np.array([rng.uniform(-1, 1) for _ in some])
        model = linear.Lookup(np.array(some, dtype=np.int64), weight)
        size = len(f" {' '.join((text or '').lower().split())} ") if grams else 0
        best = []
        for i, s in enumerate(starts := _starts(size, 32, 16)):
            inside = {_hash_of(g) for p, g in grams if s <= p < s + 32 or (i == len(starts) - 1 and p >= s)}
            best.append(sum(weight[some.index(g)] for g in inside if g in some))
        assert toxicity.log_odds(text, model, 0.5) == pytest.approx(0.5 + max(best), abs=1e-6)


def test_counted_ratios_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "KEEP", 300)
    monkeypatch.setattr(toxicity, "MIN_Z", 1.5)
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["bad", "worse", "fine", "good"][2 * (y == 0) :]) for _ in range(rng.randrange(60))), y) for y in (0, 1) for _ in range(30 + 20 * y)]
    df = Counter(), Counter()
    for text, y in rows:
        df[y].update({g for _, g in _grams(text)})
    want = {}
    for g in set(df[0]) | set(df[1]):
        a, b = df[1][g] + 1.0, df[0][g] + 1.0
        r = math.log(a / 52.0) - math.log(b / 32.0)
        if df[0][g] + df[1][g] >= 3 and r and abs(r) >= 1.5 * math.sqrt(1 / a + 1 / b):
            want[_hash_of(g)] = r
    got = {r.feature: r.ratio for r in toxicity.ratios(spark.createDataFrame(rows, "text string, y int").repartition(3), 50, 30).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_toxicity_score_does_not_jump_with_length(spark):
    """One clean text growing over the window's length, character by character, and ten times as long."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    weights = model.dense()
    text = " ".join(" ".join(r.text.split()) for r in docs.join(labels.filter("toxic = 0"), "doc_id").orderBy("doc_id").collect())[: 12 * toxicity.WINDOW]
    z = [toxicity.log_odds(text[:n], weights, 0.0) for n in range(toxicity.WINDOW - 200, toxicity.WINDOW + 200, 10)]
    assert np.abs(np.diff(z)).max() < 2.0 + 0.15 * np.abs(z).max()


SIGN = {"d": re.compile("[0-9]"), "u": re.compile("[A-Z]"), "l": re.compile("[a-z\x80-\U0010ffff]")}


def _plain_quality(text):
    """Word 1- and 2-grams, shape 1- to 3-grams, as text; a word said twice is one feature."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff \t-\r]+", text)
    shapes = []
    for w in words:
        signs = [next((k for k, p in SIGN.items() if p.match(c)), c) for c in w]
        shapes.append("".join(s for i, s in enumerate(signs) if i == 0 or s != signs[i - 1]))
    out = Counter(("w", w) for w in words)
    out.update(("s", s) for s in shapes)
    out.update(("ww", a, b) if a != b else ("twice",) for a, b in zip(words, words[1:]))
    out.update(("ss", a, b) for a, b in zip(shapes, shapes[1:]))
    out.update(("sss", a, b, c) for a, b, c in zip(shapes, shapes[1:], shapes[2:]))
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("abAB9. !é\n\t", max_size=60), st.integers(1, 20))
def test_quality_features_equal_a_plain_version(text, block):
    """Equal counts of features, whatever the blocks; a feature's number is a hash, so only its counts compare."""
    before, bits = quality_classifier.BLOCK, quality_classifier.DIM_BITS
    quality_classifier.DIM_BITS = 50
    try:
        whole = quality_classifier.sparse_row(text)
        quality_classifier.BLOCK = block
        cut = quality_classifier.sparse_row(text)
    finally:
        quality_classifier.BLOCK, quality_classifier.DIM_BITS = before, bits
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
    want = sorted(_plain_quality(text).values())
    total = sum(want)
    assert len(want) == len(whole[0])
    assert sorted((whole[1] ** 2 * max(total, 1)).round(6).tolist()) == [float(x) for x in want]


def test_quality_of_a_long_text_has_no_cut():
    text = " ".join(f"Wort{i % 4000} é," for i in range(200_000))
    assert len(text.encode()) > 2 * quality_classifier.BLOCK
    f, _ = quality_classifier.sparse_row(text)
    wide = quality_classifier.BLOCK
    quality_classifier.BLOCK = 1 << 30
    try:
        assert f.tolist() == quality_classifier.sparse_row(text)[0].tolist()
    finally:
        quality_classifier.BLOCK = wide
