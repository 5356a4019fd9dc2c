"""Classifiers, licences, fingerprints, BPE and token counts against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tenure.llm import bpe, fingerprints, licenses, quality_classifier, token_counts, toxicity
from tenure.llm.labelled import labelled_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
MED = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.95), ("op4_quality", "quality", 0.95)])
def test_classifiers_on_held_out_labels(spark, name, label, least):
    rows = entry.queries()[name](spark, MED).join(spark.read.parquet(f"{MED}/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert held.score.between(0, 1).all()
    assert (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("classifier, label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_on_odd_rows(spark, odd, none, docs, classifier, label):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = classifier.train(docs, labels)
    scores = odd.select("doc_id", "text", classifier.score(F.col("text"), model).alias("s")).collect()
    assert len(scores) == 10 and all(0 <= r.s <= 1 for r in scores)
    assert len({r.s for r in scores if not r.text}) == 1  # null and empty: the intercept
    assert none.select(classifier.score(F.col("text"), model)).count() == 0
    one_class = classifier.train(docs, labels.filter(f"{label} = 1"))
    assert len(one_class.index) == 0 and one_class.intercept > 0
    assert classifier.train(docs, labels.limit(0)).intercept == pytest.approx(0.0)


def test_labelled_sample_is_bounded_and_leaves_the_fold_out(spark):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)] + [(None, True), (3, False)], "doc_id long, toxic boolean")
    ids, share = labelled_ids(labels.withColumn("toxic", F.col("toxic").cast("int")), "toxic", 20, 1)
    got = ids.collect()
    assert Counter(r.y for r in got) == {0: 20, 1: 20}
    assert all(zlib.crc32(str(r.lab_id).encode()) % 4 != 2 for r in got) and 0.25 < share < 0.42


def test_licence_scan_equals_all_pairs(spark, docs, odd, none):
    extra = spark.createDataFrame(
        [(900, licenses.TEMPLATES["MIT"][2].replace(". ", ".\n") + "\n\nunrelated words here"), (901, "Released under\nthe MIT License."), (902, "the MIT License")], "doc_id long, text string"
    )
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    want = set()
    for r in rows.collect():
        plain = licenses.normalised(r.text)
        lines = [x.split() for x in plain.split(b"\n")]
        paragraphs = [x.replace(b"\n", b" ").split() for x in b"\n".join(b" ".join(x) for x in lines).split(b"\n\n")]
        for name, texts in licenses.TEMPLATES.items():
            best = max((licenses.dice(s, licenses.normalised(t).split()) for s in [*lines, *paragraphs, plain.split()] for t in texts), default=0)
            if best >= licenses.THRESHOLD:
                want.add((r.doc_id, name, round(best, 9)))
    got = {(r.doc_id, r.licence, round(r.dice, 9)) for r in licenses.scan_licences(rows).collect()}
    assert got == want and {i for i, *_ in got} >= {900, 901}
    assert licenses.scan_licences(none).count() == 0


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = " ".join(rng.choice(list("abcdefghijk"), 4000))
    b = a[:4000] + " zz" * 5 + a[4030:]
    x, y = fingerprints.sketch(a, k=512), fingerprints.sketch(b, k=512)
    sa, sb = _shingles(a), _shingles(b)
    assert fingerprints.resemblance(x, y, 512) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.06)
    assert fingerprints.distinct_shingles(x, 512) == pytest.approx(len(sa), rel=0.12)
    assert fingerprints.containment(x, y, 512) == pytest.approx(len(sa & sb) / len(sa), abs=0.12)
    assert fingerprints.resemblance(fingerprints.sketch(""), fingerprints.sketch(None)) == 1.0
    assert fingerprints.resemblance(fingerprints.sketch("x"), fingerprints.sketch(" ")) == 0.0
    assert len(fingerprints.sketch("w " * 100_000)) == 1


def test_merged_sketches_are_the_sketch_of_the_union(spark, docs):
    rows = docs.select("lang", "text", fingerprints.sketches(F.col("text")).alias("sketch"))
    for r in fingerprints.merged(rows, "lang").collect():
        parts = [fingerprints.sketch(t.text) for t in rows.filter(F.col("lang") == r.lang).select("text").collect()]
        assert r.sketch == np.unique(np.concatenate(parts))[: fingerprints.K].tolist()


def test_edited_pairs(spark, docs, odd, none):
    for rows in (docs, odd, odd.limit(1)):
        texts = [(r.doc_id, r.text or "") for r in sorted(rows.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))]
        want = []
        for i, (doc_id, text) in enumerate(texts):
            following, cut = texts[(i + 1) % len(texts)][1], len(text) // 4
            edited = text[: len(text) - cut] + following[:cut]
            a, b, c = map(fingerprints.sketch, (text, edited, following))
            want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_text(a), fingerprints.resemblance(a, b), fingerprints.resemblance(a, c)))
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in fingerprints.edited_pairs(rows).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fingerprints.edited_pairs(none).count() == 0


def test_bpe_equals_the_library(spark, odd, none, docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = []
    for r in rows.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(rows, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(none, PATH).count() == 0
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH), PATH)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}


def test_merge_gadgets_on_a_small_vocabulary():
    def plain(word, merges):
        parts = list(word)
        for a, b, _ in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    names = ["a", "b", "aa", "ab", "aab", "ba", "aaaa", "abba"]
    merges = [("a", "a", "aa"), ("a", "b", "ab"), ("aa", "b", "aab"), ("b", "a", "ba"), ("aa", "aa", "aaaa"), ("ab", "ba", "abba")]
    ids = {n: i for i, n in enumerate(names)}
    tables = bpe.compile_merges([n.encode() for n in names], [(-1, -1, -1)] * len(names), [(ids[a], ids[b], ids[c]) for a, b, c in merges], {})
    automaton = bpe.Automaton(tables)
    words = [format(i, f"0{n}b").replace("0", "a").replace("1", "b") for n in range(1, 9) for i in range(2**n)]
    got = automaton.encode_words([w.encode() for w in words])
    assert [[names[i] for i in x] for x in got] == [plain(w, merges) for w in words]


def test_token_counts(spark, odd, none):
    automaton = bpe.Automaton(bpe.read_tables(PATH), special=False)
    want = sorted(((r.doc_id, len(automaton.encode([r.text])[0])) for r in odd.collect()), key=repr)
    assert sorted(map(tuple, token_counts.document_counts(odd.repartition(3), PATH).collect()), key=repr) == want
    assert token_counts.document_counts(none, PATH).count() == 0


def test_separator_scan_across_blocks(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for name, size in ((1, 3), (2, 50), (3, 1)):
        flat = (rng.random(4001) < 0.002).astype("<u2") * 9 + 1  # 10 ends a document; many blocks have none
        ends = np.flatnonzero(flat == 10)
        starts = np.concatenate(([0], ends + 1))
        want += [(name, i, int(s), int(e - s)) for i, (s, e) in enumerate(zip(starts, [*ends, len(flat)])) if i < len(ends) or e > s]
        rows += [(name, b, bytearray(flat[i : i + size].tobytes())) for b, i in enumerate(range(0, len(flat), size))]
    blocks = spark.createDataFrame(rows, "file long, block long, ids binary")
    assert sorted(map(tuple, token_counts.count_tokens(blocks, 10, 2).collect())) == sorted(want)
    assert token_counts.count_tokens(blocks.limit(0), 10, 2).count() == 0
