"""Ranked search against a plain scoring of every document, and against SQL."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tenure.llm import ranked

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, want in asked.items():
        found = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if c[t])
            found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def test_term_pieces(monkeypatch):
    text = "Ab-c é9'Z\x00\x1f\x7f日本 " * 50 + "End"
    monkeypatch.setattr(ranked, "PIECE", 7)
    assert [t.decode() for piece in ranked.term_pieces(text.encode()) for t in piece] == terms(text)
    assert [*ranked.term_pieces(None), *ranked.term_pieces(b"")] == []


@pytest.mark.parametrize("cells, least, pairs, step", [(1 << 24, 64, 1 << 15, 8), (1, 5, 40, 1), (1 << 12, 64, 300, 2)])
def test_search_equals_a_plain_version(spark, docs, odd, monkeypatch, cells, least, pairs, step):
    for name, value in (("CELLS", cells), ("LEAST_ROWS", least), ("PAIRS", pairs), ("STEP", step)):
        monkeypatch.setattr(ranked, name, value)
    copies = spark.createDataFrame([(5_000 + i % 40, "One two THREE, four!") for i in range(80)] + [(6_000, "one " * 300_000 + "rare-word"), (6_001, "word"), (None, "one two")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(copies)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").limit(12).collect()
    items = [tuple(r) for r in items] + [(100, None), (101, ""), (102, "?!"), (103, "One two one"), (103, "One two one"), (104, "unheard"), (105, "rare"), (105, "word"), (None, "four three"), (106, "Café 日本")]
    got = ranked.search(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain([tuple(r) for r in rows.collect()], items)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 5), st.integers(1, 9), min_size=1), min_size=1, max_size=40), st.integers(1, 6), st.sets(st.integers(0, 5), min_size=1))
def test_best_positions_stop_at_the_right_documents(rows, k, asked):
    weight = np.array([900, 500, 500, 30, 1, 0])
    sizes = np.array([len(r) for r in rows])
    length = np.array([sum(r.values()) for r in rows])
    shard = ranked.Shard(
        np.arange(len(rows)), np.zeros(len(rows), bool), length, np.array([t for r in rows for t in sorted(r)]), np.array([r[t] for r in rows for t in sorted(r)]),
        sizes, weight, len(rows), int(length.sum()),
    )
    best = ranked.Best(k)
    assert shard.search(np.array(sorted(asked)), best) <= len(rows)
    full = []
    for i, r in enumerate(rows):
        m = 10 + 90 * int(length[i]) * len(rows) // int(length.sum())
        full.append((-sum(int(weight[t]) * (10**9 * r[t] // (1000 * r[t] + 8 * m)) for t in asked if t in r), i))
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == [x for x in sorted(full) if x[0] < 0][:k]


def test_search_stops_early():
    """Most documents stay unseen; how far the list is read depends on the ties at the k-th score."""
    n = 20_000
    shard = ranked.Shard(np.arange(n), np.zeros(n, bool), np.full(n, 100), np.zeros(n, int), np.arange(n, 0, -1), np.ones(n, int), np.array([100]), n, 100 * n)
    best = ranked.Best(10)
    assert shard.search(np.array([0]), best) < n / 20 and best.id.tolist() == list(range(10))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    none_docs, none_items = spark.createDataFrame([], docs.schema), spark.createDataFrame([], items.schema)
    assert ranked.search(none_docs, items).count() == ranked.search(docs, none_items).count() == 0
    assert [tuple(r) for r in ranked.search(docs, items).collect()] == plain([(1, "a b")], [(1, "b")])


def test_query_equals_sql(spark):
    got = entry.queries()["op12_ranked"](spark, SMALL)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(entry.oracle_sql()["op12_ranked"]).fetchall())
