"""Quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are maximal runs of letters and digits (case kept) or of other characters that are
not white space, so "THE!!" gives "THE" and "!!". Each word also stands as its shape (upper, lower,
digits or its own punctuation; runs of one kind are one sign), which tells shouting, tables
and symbol noise apart from prose whatever the words are. Features are the hashed word
1- and 2-grams and shape 1- to 3-grams; the value of a feature is sqrt(count), and the row
is scaled to length 1. The model is a fixed-size weight vector learned by FTRL-proximal updates
(per-coordinate rates, L1 and L2) over ``EPOCHS`` passes of a bounded labelled sample; a score is
a sparse dot product.

Defined cases: null and empty texts have no features and get the intercept's score; one
class only, or no labels, gives the class share to every text; repeated rows and ties score alike, extra columns play no
part. Texts of any length are read whole: their words are hashed in blocks of about ``BLOCK`` bytes that end at white
space, and n-grams go over the ends of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from tenure.llm import linear
from tenure.llm.labelled import labelled_texts
from tenure.llm.words import blocks

DIM_BITS = 18
SAMPLE_PER_CLASS = 3000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.001
THRESHOLD = 0.7
BLOCK = 1 << 20

# Kinds of bytes: 0 white space, 1 letter or digit (every byte beyond ASCII too), 2 other.
_KIND = np.full(256, 2, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
# Signs of a shape: digits, upper case, lower case; other bytes stand for themselves.
_SIGN = np.arange(256, dtype=np.uint64)
_SIGN[48:58], _SIGN[65:91], _SIGN[97:123], _SIGN[128:] = 1, 2, 3, 3
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _runs_hash(codes: np.ndarray, starts: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A hash of codes[starts[i]:starts[i+1]] for each i; ``powers`` by place in the run."""
    return _mix(np.add.reduceat((codes + np.uint64(7)) * powers, starts))


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and of their shapes."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(edge, np.diff(np.append(edge, len(data))))
    table = np.full(min(int(place.max()) + 1, 64), _P, dtype=np.uint64)
    table[0] = 1
    powers = np.cumprod(table)
    word = _runs_hash(data.astype(np.uint64), edge, powers[place % len(table)])
    sign = _SIGN[data]
    # A sign counts once in a run of equal signs, by its order of first appearance.
    new = np.concatenate(([True], sign[1:] != sign[:-1]))
    new[edge] = True
    step = np.cumsum(new)
    step = step - np.repeat(step[edge], np.diff(np.append(edge, len(data))))
    shape = _runs_hash(np.where(new, sign + np.uint64(300), np.uint64(0)), edge, np.where(new, powers[step % len(table)], np.uint64(0)))
    keep = kind[edge] != 0
    return word[keep], shape[keep]


def _features(word: np.ndarray, shape: np.ndarray) -> np.ndarray:
    grams = [word, shape ^ np.uint64(0x5851F42D4C957F2D)]
    if len(word) > 1:
        # A word said twice is one feature, whichever word it is.
        pair = np.where(word[:-1] == word[1:], _P, word[:-1] * np.uint64(3) + word[1:])
        grams += [_mix(pair), _mix(shape[:-1] * np.uint64(5) + shape[1:])]
    if len(word) > 2:
        grams.append(_mix(shape[:-2] * np.uint64(25) + shape[1:-1] * np.uint64(5) + shape[2:] + np.uint64(1)))
    return (np.concatenate(grams) >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def sparse_row(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a text: distinct hashed n-grams, sqrt of counts, length 1."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data) or not (_KIND[data] != 0).any():
        return np.empty(0, dtype=np.int64), np.empty(0)
    parts = [_block_words(data[i:j]) for i, j in blocks(data, BLOCK)]
    f, n = np.unique(_features(*(np.concatenate(x) for x in zip(*parts))), return_counts=True)
    x = np.sqrt(n)
    return f, x / np.sqrt(n.sum())


def packed(text: str | None) -> np.ndarray:
    """``sparse_row`` as one array of ints: features, then the bits of the values as float32."""
    f, x = sparse_row(text)
    return np.concatenate((f.astype(np.int32), x.astype(np.float32).view(np.int32)))


def log_odds(text: str | None, weights: np.ndarray, intercept: float) -> float:
    f, x = sparse_row(text)
    return intercept + float(np.dot(weights[f], x)) if len(f) else intercept


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over ``rows`` in a seeded order for each epoch; the last coordinate is the intercept."""
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    l1 = np.full(dim + 1, L1)
    l1[dim] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = np.append(rows[k][0], dim), np.append(rows[k][1], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(dim + 1))
    return w[:dim], float(w[dim])


def fit(found: list[np.ndarray], y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept) from packed rows; the intercept is moved to the class share of all training rows."""
    y = np.asarray(y, dtype=np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    prior = min(max(share, 1e-3), 1 - 1e-3)
    if not n1 or not n0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), float(np.log(prior / (1 - prior)))
    rows = [(p[: len(p) // 2].astype(np.int64), p[len(p) // 2 :].view(np.float32).astype(np.float64)) for p in map(np.ascontiguousarray, found)]
    w, b = ftrl(rows, y, 1 << DIM_BITS)
    used = np.flatnonzero(w)
    return used, w[used].astype(np.float32), float(b + np.log(prior / (1 - prior)) - np.log(n1 / n0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, seed: int = 2) -> linear.Model:
    """Fit on the bounded sample: features in parallel, then one task over at most 2 x ``per_class`` rows."""
    sample, share = labelled_texts(docs, labels, label, per_class, seed)
    return linear.train_in_one_task(sample, packed, lambda rows, y: fit(rows, y, share), 1 << DIM_BITS, share)


def score(text: Column, model: linear.Model) -> Column:
    """Probability of class 1 for each text."""
    return linear.scorer(model, log_odds)(text)
