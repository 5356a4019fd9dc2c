"""Mixing: weights as arguments, and the end of a leaf's prefix among crowded ids, against a plain version."""

from __future__ import annotations

import hashlib

import pytest

from tenure.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def test_weights_are_arguments(spark):
    rows = [(i, "w " * 10, "xx" if i % 2 else "yy", "a" if i % 4 < 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = mixing.Weights({"a": "left", "b": "right"}, {"left": 3, "right": 1}, {"xx": 1, "yy": 4})
    got = {tuple(r)[:2]: r[2] for r in mixing.mix(docs, weights=weights).groupBy("__domain", "lang").sum("__tokens").collect()}
    assert got == {("left", "xx"): 600, ("left", "yy"): 2400, ("right", "xx"): 200, ("right", "yy"): 800}
    with pytest.raises(ValueError):
        mixing.Weights(domains={"left": 0})


@pytest.mark.parametrize("ids", ["apart", "one", "null"])
def test_prefix_of_a_leaf_equals_a_plain_version(spark, ids):
    """Rows of one id (or none) differ in token count and text: the prefix still ends at the right row."""
    make = {"apart": lambda i: i, "one": lambda i: 7, "null": lambda i: None}[ids]
    rows = [(make(i), " ".join(["w"] * (i % 5) + [f"t{i}"]), "en", "src0") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(doc_id, text, lang, source) as h").collect()}
    tokens = sum(len(t.split()) for _, t, _, _ in rows)
    rest, want = tokens * 37 // 100, []

    def place(r):
        return hashlib.md5(f"{mixing.SEED}:1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), len(r[1].split()), hashes[r[1]] % 2**64

    for r in sorted(rows, key=place):
        rest -= len(r[1].split())
        if rest < 0:
            break
        want.append(r[1])
    for buckets in (1, 4096):
        assert sorted(r.text for r in mixing.mix(docs, budget_percent=37, buckets=buckets).collect()) == sorted(want)


def test_equal_rows_come_all_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "src0")] * 10, SCHEMA)
    assert mixing.mix(docs, budget_percent=50).count() == 0
    assert mixing.mix(docs, budget_percent=150).count() == 10
