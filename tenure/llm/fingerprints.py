"""Document fingerprints: bottom-k sketches of 5-word shingle hashes.

A sketch is the k smallest distinct hashes (63 bits) of a text's shingles, ascending. The sketch of a
union is the k smallest of the sketches' hashes, so sketches of parts merge. From two sketches:
resemblance = share of the k smallest hashes of their union that both hold; distinct
shingles = (k - 1) / (k-th smallest hash as a fraction of the hash range), exact below k; containment
of A in B = resemblance x |A or B| / |A|.

Words are runs other than white space with A-Z as a-z. Fewer than 5 words are one shingle; null, empty
and blank texts have the empty sketch, which resembles the empty sketch (1.0) and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.tables import shuffle_parts
from tenure.llm.words import mix, word_hashes

K = 64
WORDS = 5
RANGE = float(1 << 63)
SALTS = 64


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The sketch of one text."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, dtype=np.int64)
    n = min(words, len(w))
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h = mix(h) + w[i : len(w) - n + 1 + i]
    h = (mix(h) >> np.uint64(1)).astype(np.int64)
    if len(h) > 8 * k:  # repeats may hide more than k distinct hashes below the pivot's place
        low = np.unique(np.partition(h, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b)).sum() / len(union))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / RANGE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of A's shingles that B has; 1.0 for an empty A."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_shingles(np.union1d(a, b)[:k], k) / distinct_shingles(a, k))


def as_text(a: np.ndarray) -> str:
    """16 hex digits for each hash, smallest first."""
    return a.astype(">i8").tobytes().hex()


def sketches(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sketch (array<long>) of each text."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, k, words) for t in texts])

    return run(text)


def merged(rows: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): the sketch of all texts of a key from the sketches of its rows.

    Hashes are ranked within (key, salt) first, of which at most k go on, so a key that holds
    most rows is shared out. A null key is a key.
    """
    hashes = rows.select(key, F.explode(column).alias("h")).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    for by in ([key, "salt"], [key]):
        hashes = hashes.withColumn("r", F.dense_rank().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("r") <= k).drop("r").distinct()
    return hashes.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def _targets(docs: DataFrame):
    """A column function: doc_id -> ranges a row goes to: its own, and as -1 - r the range r whose last row it follows."""
    parts = shuffle_parts(docs.sparkSession)
    ids = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], F.lit(100 * parts))).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))  # a range ends with its cut

    def ranges(x: pd.Series) -> np.ndarray:
        return np.searchsorted(cuts, x.to_numpy(dtype=np.int64), side="left")

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(ranges(x), dtype="int32")

    low = sorted((r.part, r.low) for r in ids.groupBy(range_of("id").alias("part")).agg(F.min("id").alias("low")).collect())
    follows = {low[i][1]: low[i - 1][0] for i in range(len(low))}  # first id of a range -> the range before (cyclic)

    @F.pandas_udf("array<int>")
    def targets(x: pd.Series) -> pd.Series:
        return pd.Series([[r, -1 - follows[i]] if i in follows else [r] for r, i in zip(ranges(x).tolist(), x.tolist())])

    return targets(F.coalesce("doc_id", F.lit(-(2**63))))


def edited_pairs(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each text beside its edited text and the next document's, as the op3 query returns them.

    Next: ascending doc_id (null ids first, rows of one id by text), after the last the first. Rows go to
    ranges of ids in one shuffle; the first row of each range also goes to the range before, whose last
    row it follows. Ranges are cut at approximate quantiles of all ids.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(_targets(docs)).alias("to"))
    rows = rows.select("doc_id", "text", (F.col("to") >= 0).alias("own"), F.when(F.col("to") >= 0, F.col("to")).otherwise(-1 - F.col("to")).alias("part"))

    def run(batches):
        held = None  # (part, doc_id, text, sketch) whose next row is still to come

        for batch in batches:
            out = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for part, own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
                if held is None or held[0] != part:
                    held = None
                if held is None and not own:
                    continue
                mine = sketch(text, k, words)
                if held is not None:
                    _, last_id, last, last_sketch = held
                    cut = len(last) // 4
                    edited = last[: len(last) - cut] + text[:cut]
                    edited_sketch = sketch(edited, k, words)
                    out["doc_id"].append(last_id)
                    out["n_chars"].append(len(last))
                    out["edited_sha256"].append(hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest())
                    out["fingerprint"].append(as_text(last_sketch))
                    out["edited_fingerprint"].append(as_text(edited_sketch))
                    out["near_edited"].append(resemblance(last_sketch, edited_sketch, k))
                    out["near_next"].append(resemblance(last_sketch, mine, k))
                held = (part, doc_id, text, mine) if own else None
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), types)})

    spread = rows.repartition("part").sortWithinPartitions("part", F.col("own").desc(), "doc_id", "text")
    return spread.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
