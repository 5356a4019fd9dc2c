"""The Merkle manifest against a plain version built level by level, and against SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenure.llm import merkle

SMALL = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(side, sibling) at each level: 0 left child, 1 right child; sibling None if alone."""
    out = []
    for nodes in levels[:-1]:
        out.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        i >>= 1
    return out


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the query's rows."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    built = {lang: levels([x[2] for x in sorted(found, key=lambda x: x[:3])]) for lang, found in trees.items()}
    langs = sorted(built, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([built[x][-1][0] for x in langs])
    out = []
    for t, lang in enumerate(langs):
        for i, (_, _, leaf, row) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            steps = path(built[lang], i) + path(top, t)
            node = leaf
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = leaf_of(*row[:3], row[3] + 1, row[4])
            for side, sibling in steps:
                node = sha(node) if sibling is None else sha(sibling, node) if side else sha(node, sibling)
            out.append((row[0], leaf, built[lang][-1][0], top[-1][0], sha(*(s for _, s in steps if s)), node, node == top[-1][0]))
    return out


def query(docs):
    rows = merkle.verify(docs.select(*merkle.FIELDS), merkle.tampered_fold("doc_id"), {"n_chars": F.col("n_chars") + 1})
    return sorted(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_appended_witnesses_lead_to_the_root(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    trees = merkle.Appender()
    for d in digests:
        trees.append(d)
    root = trees.close(merkle.height_of(n))
    want = levels([d.hex() for d in digests])
    assert root.hex() == want[-1][0]
    for i, d in enumerate(digests):
        assert [w.hex() for w in trees.witness[i]] == [s for _, s in path(want, i) if s]
        assert merkle.fold(d, b"".join(trees.witness[i]), merkle.steps_of(i, n)) == root


@pytest.mark.parametrize("height", [12, 3, 1])
def test_manifest_equals_a_plain_version(spark, docs, odd, monkeypatch, height):
    monkeypatch.setattr(merkle, "LEVELS", height)
    monkeypatch.setattr(merkle, "BLOCK", 1 << height)
    more = spark.createDataFrame([(9_000 + i, None, f"l{i % 21}", i, "x" * i) for i in range(60)] + [(9_999, "s", "big", 3, "é" * 2_000_000)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = docs.select(*merkle.FIELDS).unionByName(odd.select(*merkle.FIELDS)).unionByName(more.select(*merkle.FIELDS))
    if height == 1:
        rows = rows.filter("lang IS NULL OR lang NOT IN ('en', 'de')")
    want = plain([tuple(r) for r in rows.collect()])
    got = query(rows)
    assert got == sorted(want, key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_odd_tables(spark, none):
    assert query(none) == []
    one = spark.createDataFrame([(7, "s", "en", 2, "ab", "x")], "doc_id long, source string, lang string, n_chars long, text string, root string")
    assert query(one) == plain([(7, "s", "en", 2, "ab")])
    same = spark.createDataFrame([(7, "s", "en", 2, "ab")] * 9 + [(None, None, None, None, None)] * 3, "doc_id long, source string, lang string, n_chars long, text string")
    assert query(same) == sorted(plain([tuple(r) for r in same.collect()]), key=repr)


def test_query_equals_sql(spark):
    got = entry.queries()["op11_merkle"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()["op11_merkle"])
    assert [c[0] for c in cur.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
