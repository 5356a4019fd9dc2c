"""SimHash groups, mixing, neighbours, the language model and the pipeline against plain versions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline
from tenure.llm import ann, katz, mixing, quality_classifier, simhash, toxicity
from tenure.llm.components import components
from tenure.llm.tables import held_out_fold

SMALL = "/root/testdata/sf0.001"


def _fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\x0b\x0c\r":
        lower = lower.replace(gap, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps):
    """Smallest index reachable from each, at 3 bits or fewer."""
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash_groups(spark, docs, odd, none):
    near = [(1000 + i, " ".join(f"w{j}" for j in range(400)) + " x" * i) for i in range(12)]
    near = near + [(2000 + i, t) for i, t in near]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    found = rows.collect()
    fps = [_fingerprint(r.text) for r in found]
    root = _groups(fps)
    low = defaultdict(list)
    for g, r in zip(root, found):
        if r.doc_id is not None:
            low[g].append(r.doc_id)
    want = [(r.doc_id, f"{f:016x}", min(low[g]) if low[g] else None) for r, f, g in zip(found, fps, root)]
    assert sorted(map(tuple, simhash.near_duplicates(rows).collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0


def test_links_with_sliced_buckets(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False))) for n in (0, 1, 2, 3, 4, 5) for _ in range(6)]
    fps = np.unique(np.array([b ^ f for b in base for f in flips], dtype=np.uint64))
    want = {tuple(sorted((int(a), int(b)))) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)).bit_count() <= 3}
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for slice_rows in (100_000, 7):
        got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.links(nodes, slice_rows=slice_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 6)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_drop_near_duplicates_keeps_one_row_and_all_columns(spark, odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 1), (False, 3), (False, 5), (False, 5), (False, 7), (True, None)]
    assert simhash.drop_near_duplicates(none).count() == 0


def test_quotas_share_shortages_among_siblings_first(spark):
    rows = [("web", "en", "s1", 10), ("web", "en", "s2", 1000), ("web", "de", "s3", 400), ("books", "en", "s4", 5)]
    got = {r.source: r.quota for r in mixing.quotas(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), 100, 2).collect()}
    # books: limit 10 is below its share; web gets 1405; de: 15/75 of it = 281; en: 1124, s1 is full at 20, s2 takes the rest.
    assert got == {"s4": 10, "s3": 281, "s1": 20, "s2": 1104}


def test_mixing_equals_sql(spark):
    name = "op5_mixing"
    rows = entry.queries()[name](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_mixing_is_native_and_takes_odd_rows(spark, odd, none):
    mixed = mixing.mix(odd)
    assert "Python" not in mixed._jdf.queryExecution().toString() and "Arrow" not in mixed._jdf.queryExecution().toString()
    assert mixed.drop(*mixing.mixed_names(odd)).columns == odd.columns
    tokens = sum(len((r.text or "").split()) for r in odd.collect())
    assert 0 < sum(r[mixing.mixed_names(odd)[2]] for r in mixed.collect()) <= tokens
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_mixing_does_not_depend_on_the_buckets(spark, docs, buckets):
    def rows(df):
        return sorted(map(tuple, df.drop("text").collect()))

    assert rows(mixing.mix(docs, buckets=buckets)) == rows(mixing.mix(docs))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)) * rng.uniform(0.2, 3, (400, 1))
    x[50:90] = x[50]  # ties
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [(None, [1.0] * 8), (500, None), (501, [0.0] * 8), (502, [1.0] * 7 + [None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, [1.0] * 3), (506, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = ann.search(table, table.filter("vec_id % 20 = 0")).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    y = np.array([r for _, r in rows])
    hits = 0
    for q in range(0, 400, 20):
        s = (y * y[q]).sum(axis=1)
        best = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        assert all(score == pytest.approx(s[i], abs=1e-12) for i, score in found[q]) and len(found[q]) == 20
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
        hits += len(set(best) & {i for i, _ in found[q]})
    assert hits >= 0.9 * 400 and set(found) == set(range(0, 400, 20))
    few = table.filter("vec_id < 5")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 4
    assert ann.search(table.limit(0), table.limit(0)).count() == 0


def test_hilbert_curve_steps_to_a_neighbouring_cell():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = ann.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def _turing(counts):
    """Good-Turing: discounted count of every count from 1 on, from the counts of a counter's keys."""
    of = Counter(counts.values())
    rest = 6 * of[6] / of[1] if of[1] else 1.0

    def kept(r):
        if r > 5:
            return float(r)
        d = (((r + 1) * of[r + 1] / (r * of[r]) if of[r] else 0.0) - rest) / (1 - rest) if rest < 1 else 0.0
        return r * d if 0 < d < 1 else r - 0.5

    return kept


def _katz(texts, train, order):
    """Plain version, straight from the definition: P(w | h), the counts of words, log10 of a whole text."""
    grams = [Counter() for _ in range(order + 1)]  # by length; n-grams are tuples
    for words, t in zip(texts, train):
        padded = ["<s>"] * (order - 1) + words
        for i in range(order - 1, len(padded)) if t else ():
            for k in range(1, order + 1):
                grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    kept = [None, *(_turing(g) for g in grams[1:])]
    after = defaultdict(list)
    for g in grams[2:]:
        for x in g:
            after[x[:-1]].append(x[-1])
    total = sum(grams[1].values())
    free = sum(r - kept[1](r) for r in grams[1].values() if r <= 5)
    total, free = (total, free) if free else (total + 1.0, 1.0)
    divisor = {}

    def p(w, h):
        if not h:
            r = grams[1][w,]
            return kept[1](r) / total if r else free / total
        r, shorter = grams[len(h) + 1][*h, w], h[1:]
        if h not in after:
            return p(w, shorter)
        if h not in divisor:
            of = [grams[len(h) + 1][*h, x] for x in after[h]]
            own = sum(kept[len(h) + 1](n) for n in of)
            s = sum(of) + (own >= sum(of))
            divisor[h] = s, (1 - own / s) / (1 - sum(p(x, shorter) for x in after[h]))
        s, alpha = divisor[h]
        return kept[len(h) + 1](r) / s if r else alpha * p(w, shorter)

    def score(words):
        padded = ["<s>"] * (order - 1) + words
        return sum(math.log10(p(padded[i], tuple(padded[i - order + 1 : i]))) for i in range(order - 1, len(padded)))

    return p, Counter({w: n for (w,), n in grams[1].items()}), score


def _tokens(text):
    return [*(text or "").encode().lower().split(), "</s>"]


# Many parts: the commonest words and pairs of words (the start signs too) are spread over parts.
@pytest.mark.parametrize("order, parts", [(2, 64), (3, 3), (3, 64), (3, 400), (4, 64)])
def test_katz_equals_plain_version(spark, docs, odd, order, parts):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        hot = katz.hot_contexts(rows, parts, order)
        got = sorted(katz.score_texts(rows, held_out_fold("doc_id", 7), order).collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {length for _, _, length in hot} >= ({1} if order == 2 else {1, 2} if parts > 3 else set())
    found = rows.collect()
    texts = [_tokens(r.text) for r in found]
    train = [r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in found]
    p, uni, score = _katz(texts, train, order)
    n, v = sum(uni.values()), len(uni)
    want = sorted([(r.doc_id, len(t), sum(w in uni for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score(t), not k) for r, t, k in zip(found, texts, train)], key=repr)
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out) for r in got], key=repr)
    assert [x[:4] + x[6:] for x in got] == [x[:4] + x[6:] for x in want]
    assert all(a == pytest.approx(b, rel=1e-9) for x, y in zip(got, want) for a, b in zip(x[4:6], y[4:6]))
    long = max((t for t, k in zip(texts, train) if k), key=len)
    for h in [("<s>",) * (order - 1), (b"the",), (b"nowhere",), *(tuple(long[i : i + k]) for k in range(1, order) for i in (0, 7, 20))]:
        assert sum(p(w, h) for w in uni) + p("never seen", h) == pytest.approx(1.0, abs=1e-9)


def test_katz_on_an_empty_table(spark, none):
    assert katz.score_texts(none, held_out_fold("doc_id", 7)).count() == 0


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bad, good = toxicity.train(docs, labels), quality_classifier.train(docs, labels)
    chance = lambda z: 1 / (1 + math.exp(-z))
    kept = [i for i, r in rows.items() if chance(toxicity.log_odds(r.text, bad.dense(), bad.intercept)) < 0.3]
    kept = sorted(i for i in kept if chance(quality_classifier.log_odds(rows[i].text, good.dense(), good.intercept)) >= 0.7)
    root = _groups([_fingerprint(rows[i].text) for i in kept])
    kept = [i for k, i in enumerate(kept) if root[k] == k]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet' WHERE doc_id IN ({','.join(map(str, kept))})")
    want = Counter(i for (i,) in con.execute(f"SELECT doc_id FROM ({entry.oracle_sql()['op5_mixing']})").fetchall())
    assert Counter(r.doc_id for r in entry.queries()["pipeline"](spark, SMALL).collect()) == want and want


def test_pipeline_stages_take_odd_rows(spark, odd, none):
    for rows in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == rows.columns, name
            assert out.count() <= 3 * rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == rows.count()
