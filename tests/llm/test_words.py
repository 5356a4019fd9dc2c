"""Word hashes do not depend on the words around them, whatever their lengths."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tenure.llm import fingerprints, katz
from tenure.llm.tables import held_out_fold
from tenure.llm.words import word_hashes

URL = "https://www.example.com/a/very/long/path/that/is/well/over/sixty-four/bytes/of/text?and=a&query=too"
WORDS = st.one_of(st.text("abAB.é", min_size=1, max_size=6), st.integers(60, 300).map(lambda n: "xyz"[n % 3] * n), st.just(URL))


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, max_size=12))
def test_hash_of_a_word_is_the_same_in_any_company(words):
    alone = [word_hashes(w)[0] for w in words]
    assert word_hashes(" \n".join(words)).tolist() == [int(h) for h in alone]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    for i, a in enumerate(lower):
        for j in range(i):
            assert (alone[i] == alone[j]) == (a == lower[j])


def test_pieces_of_long_words_are_told_apart():
    a, b = "a" * 64, "b" * 64
    texts = [a, a + a, a + b, b + a, a + a + b, a + b + a, b + a + a, a + "a", "a" + a + "a"]
    assert len({int(word_hashes(t)[0]) for t in texts}) == len(texts)


def _bottom(text, k, seen):
    """The k smallest of all shingle hashes, each shingle hashed in a text of its own."""
    words = text.split()
    found = set()
    for i in range(max(1, len(words) - 4)):
        shingle = " ".join(words[i : i + 5])
        if shingle not in seen:
            seen[shingle] = int(fingerprints.sketch(shingle)[0])
        found.add(seen[shingle])
    return sorted(found)[:k]


def test_sketch_is_the_bottom_of_all_shingle_hashes():
    rng, seen = np.random.default_rng(3), {}
    words = [f"w{i}" for i in range(40)] + [URL, "x" * 65, "x" * 200]
    for n in (1, 4, 5, 6, 100, 3000):
        text = " ".join(rng.choice(words, n))
        assert fingerprints.sketch(text).tolist() == _bottom(text, fingerprints.K, seen)


def test_edited_text_next_to_a_long_word_is_near(spark):
    text = " ".join(f"word{i}" for i in range(2000))
    rows = spark.createDataFrame([(1, text), (2, text.replace("word7 ", URL + " "))], "doc_id long, text string")
    for r in fingerprints.edited_pairs(rows).collect():
        assert r.near_next > 0.9


def test_katz_knows_words_next_to_a_long_word(spark):
    held = next(i for i in range(100) if spark.range(i, i + 1).select(held_out_fold("id", 7)).first()[0])
    train = [(1000 + i, "the cat sat on the mat", None) for i in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in train] + [(held, f"the cat sat {URL} on the mat"), (held, "the cat sat on the mat")], "doc_id long, text string")
    got = {(r.n_tokens, r.n_known) for r in katz.score_texts(rows, held_out_fold("doc_id", 7)).filter("held_out").collect()}
    assert got == {(8, 7), (7, 7)}
