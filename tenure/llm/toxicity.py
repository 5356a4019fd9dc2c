"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, white space runs become one blank, and every 3- to 6-gram of its
characters (with a blank at both ends) is a feature, present or absent, named by a 63-bit hash: with
a small table the many n-grams of a very long text would fall on the features of others. Feature f has the
ratio r[f] = log((df1 + a) / (n1 + 2a)) - log((df0 + a) / (n0 + 2a)) of its document frequencies in the two
classes, and only ratios more than ``MIN_Z`` standard errors from 0 are kept. The frequencies are counted in
Spark over a bounded labelled sample (``SAMPLE_PER_CLASS`` rows of each class), summed on the map side first;
only the kept features come to the driver.

A text scores by its windows of ``WINDOW`` characters, one every ``STEP`` (a shorter text is one window): the
log odds of a window are the weights of its distinct features, those of the text are its highest window's. A
logistic regression is trained on the features scaled by r, in one task, with this same rule: in each step
a text counts by the window that is highest so far. So one rule holds at every length, and neither a long clean
text nor a toxic passage in one is judged by its length.

Defined cases: null and empty texts have no features and get the intercept's score; one
class only, or no labels at all, gives the (smoothed) class share to every text; repeated rows and ties score alike, extra
columns play no part; texts of any length are read whole, hashed in blocks of ``BLOCK`` characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm import linear
from tenure.llm.labelled import labelled_texts
from tenure.llm.tables import staged
from tenure.llm.words import mix

DIM_BITS = 63
GRAMS = (3, 4, 5, 6)
SAMPLE_PER_CLASS = 2000
MIN_DF = 3
MIN_Z = 3.0
SMOOTH = 1.0
L2 = 1e-2
STEPS = 120
THRESHOLD = 0.3
STEP = 1 << 13
WINDOW = 2 * STEP
BLOCK = 1 << 16
KEEP = 1 << 19  # distinct hashes that a counting task holds at once


def gram_blocks(text: str | None):
    """Hashed features of every n-gram of ``text``, repeats included, block by block: (first place, array) for each n."""
    words = (text or "").lower().split()
    if not words:
        return
    chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(chars), BLOCK):
        part = chars[at : at + BLOCK + max(GRAMS) - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = np.full(len(part), 0xCBF29CE484222325, dtype=np.uint64)
        for n in range(1, max(GRAMS) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ part[n - 1 :]
            if n in GRAMS:
                yield at, (mix(h[:BLOCK]) >> np.uint64(64 - DIM_BITS)).view(np.int64)


def distinct_grams(text: str | None):
    """The distinct features of ``text``, in ranges of hashes, one after the other: a range holds about ``KEEP`` at most."""
    ranges = 1 + 4 * len(text or "") // KEEP
    for i in range(ranges):
        low, high = ((1 << DIM_BITS) * j // ranges for j in (i, i + 1))
        kept, size = [np.empty(0, dtype=np.int64)], 0
        for _, f in gram_blocks(text):
            kept.append(f if ranges == 1 else f[(f >= low) & (f <= high - 1)])
            size += len(kept[-1])
            if size > KEEP:
                kept = [np.unique(np.concatenate(kept))]
                size = 0
        yield np.unique(np.concatenate(kept))


def ratios(sample: DataFrame, n1: int, n0: int) -> DataFrame:
    """(feature, ratio) of the features to keep, from the document frequencies in the sample (text, y)."""

    def summed(found):
        keys, place = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
        y = np.repeat([float(y) for _, y in found], [len(f) for f, _ in found])
        df1 = np.bincount(place, weights=y, minlength=len(keys)).astype(np.int64)
        df0 = np.bincount(place, minlength=len(keys)) - df1
        for i in range(0, len(keys), BLOCK):
            part = slice(i, i + BLOCK)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(keys[part]), "df1": pa.array(df1[part], pa.int64()), "df0": pa.array(df0[part], pa.int64())})

    def run(batches):
        found, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for f in distinct_grams(batch.column("text")[i].as_py()):
                    found.append((f, batch.column("y")[i].as_py()))
                    size += len(f)
                    if size > KEEP:
                        yield from summed(found)
                        found, size = [], 0
        if found:
            yield from summed(found)

    counts = sample.select("text", "y").mapInArrow(run, "feature long, df1 long, df0 long").groupBy("feature").agg(F.sum("df1").alias("df1"), F.sum("df0").alias("df0"))
    r = F.log((F.col("df1") + SMOOTH) / F.lit(n1 + 2 * SMOOTH)) - F.log((F.col("df0") + SMOOTH) / F.lit(n0 + 2 * SMOOTH))
    # A ratio within MIN_Z standard errors of 0 is chance: with a million features, thousands would be kept.
    error = F.sqrt(1 / (F.col("df1") + SMOOTH) + 1 / (F.col("df0") + SMOOTH))
    return counts.withColumn("ratio", r).filter((F.col("df1") + F.col("df0") >= MIN_DF) & (F.col("ratio") != 0) & (F.abs("ratio") >= MIN_Z * error)).select("feature", "ratio")


def windowed(text: str | None, known: linear.Lookup) -> tuple[int, np.ndarray, np.ndarray]:
    """How many windows ``text`` has; the distinct (window, place in ``known``) pairs of its known features."""
    found, size, end = [(np.empty(0, dtype=np.int64),) * 2], len(known.key), 0
    for at, f in gram_blocks(text):
        here, place = known.found(f)
        found.append((at + here, place))
        end = max(end, at + len(f) + min(GRAMS) - 1)
    at, place = (np.concatenate(x) for x in zip(*found))
    last = max(0, -(-(end - WINDOW) // STEP))  # windows start at every STEP, the last one ends with the text
    spot, ends = at // STEP, at >= end - WINDOW
    pairs = [(spot - i)[ok] * size + place[ok] for i in range(WINDOW // STEP) for ok in [(spot >= i) & (spot - i < last)]]
    pair = np.unique(np.concatenate([*pairs, last * size + place[ends]]))
    return last + 1, pair // max(size, 1), pair % max(size, 1)


def log_odds(text: str | None, weights: linear.Lookup, intercept: float) -> float:
    """The highest window's sum of the weights of its distinct features; only features that have a weight are kept."""
    n, window, place = windowed(text, weights)
    if not len(place):
        return intercept
    windows, which = np.unique(window, return_inverse=True)
    sums = np.bincount(which, weights=weights.weight[place].astype(np.float64))
    return intercept + float(max(sums.max(), 0.0) if len(windows) < n else sums.max())


def packed(text: str | None, known: linear.Lookup) -> np.ndarray:
    """``windowed`` as one array."""
    n, window, place = windowed(text, known)
    return np.concatenate(([n], window, place))


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, used: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, intercept) from the sample's packed windows and labels.

    The intercept is moved from the sample's class shares to ``share``.
    """
    y = np.asarray(y, dtype=np.float64)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    prior = min(max(share, 1e-3), 1 - 1e-3)
    if not n1 or not n0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), float(np.log(prior / (1 - prior)))
    first = np.cumsum([0, *(r[0] for r in rows)])  # of each text among all windows
    half = [(len(r) - 1) // 2 for r in rows]
    window = np.concatenate([r[1 : 1 + k] + f for r, k, f in zip(rows, half, first)])
    col = np.concatenate([r[1 + k :] for r, k in zip(rows, half)])
    text = np.repeat(np.arange(len(rows)), np.diff(first))
    x = ratio[col]
    w, b = np.full(len(used), 0.01), 0.0  # a start at 0 would not tell the windows of a text apart
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):  # Adam on the whole sample: smooth, no learning-rate search
        z = np.bincount(window, weights=x * w[col], minlength=first[-1])
        best = np.lexsort((-np.arange(len(z)), z, text))[first[1:] - 1]  # of each text, the first of the highest windows
        err = 1 / (1 + np.exp(-np.clip(z[best] + b, -35, 35))) - y
        of_window = np.zeros(len(z))
        of_window[best] = err
        grad = np.append(np.bincount(col, weights=x * of_window[window], minlength=len(used)) / len(y) + L2 * w / max(len(used), 1) ** 0.5, err.mean())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= move[:-1]
        b -= move[-1]
    return used, (w * ratio).astype(np.float32), float(b + np.log(prior / (1 - prior)) - np.log(n1 / n0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, seed: int = 1) -> linear.Model:
    """Fit on the bounded sample: frequencies, then windows, in parallel; the fit in one task over at most 2 x ``per_class`` rows."""
    sample, share = labelled_texts(docs, labels, label, per_class, seed)
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    sample = staged(sample.repartition(parts, "lab_id"), "toxicity-sample")
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    kept = ratios(sample.repartition(parts, "lab_id"), n1, n - n1).toPandas().sort_values("feature")
    used, ratio = kept.feature.to_numpy(dtype=np.int64), kept.ratio.to_numpy(dtype=np.float64)
    known = linear.Lookup(used, ratio)
    return linear.train_in_one_task(sample, lambda t: packed(t, known), lambda rows, y: fit(rows, y, share, used, ratio), 1 << DIM_BITS, share, linear.HashedModel)


def score(text: Column, model: linear.Model) -> Column:
    """Probability of class 1 for each text."""
    return linear.scorer(model, log_odds)(text)
