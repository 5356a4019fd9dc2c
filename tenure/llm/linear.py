"""What the two linear text classifiers share: training in one task on a bounded sample, scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_BITS = 20


@dataclass(frozen=True)
class Model:
    """Weights by hashed feature (below ``dim``; only those that are not 0) and an intercept. Size: at most ``dim`` entries."""

    dim: int
    index: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(self.dim, dtype=np.float32)
        out[self.index] = self.weight
        return out


class Lookup:
    """Weights by full hash: a table of upper bits leaves out most hashes, a search in the sorted keys settles the rest."""

    def __init__(self, index: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(index, kind="stable")
        self.key, self.weight = index[order], weight[order]
        self.maybe = np.zeros(1 << LOOKUP_BITS, dtype=bool)
        self.maybe[self.key >> (63 - LOOKUP_BITS)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``hashes`` that have a weight: their places in ``hashes``, and in ``weight``."""
        here = np.flatnonzero(self.maybe[hashes >> (63 - LOOKUP_BITS)])
        if not len(here):
            return here, here
        hashes = hashes[here]
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        same = self.key[at] == hashes
        return here[same], at[same]


class HashedModel(Model):
    """A model whose index holds 63-bit hashes, too many to be places of a table."""

    def dense(self) -> Lookup:
        return Lookup(self.index, self.weight)


def train_in_one_task(sample: DataFrame, features: Callable, fit: Callable, dim: int, share: float, kind: type[Model] = Model) -> Model:
    """Extract the features of the bounded (text, y) sample in parallel, fit in one task.

    The rows are put in the order of their ids first, so the model does not depend on the layout.
    """

    @F.pandas_udf("array<long>" if kind is HashedModel else "array<int>")
    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    def run(batches):
        found = []
        for batch in batches:
            found += zip(batch.column("lab_id").to_pylist(), batch.column("y").to_pylist(), (np.asarray(x.values) for x in batch.column("features")))
        found.sort(key=lambda r: r[0])
        index, weight, intercept = fit([r[2] for r in found], np.array([r[1] for r in found])) if found else ([], [], 0.0)
        yield pa.RecordBatch.from_pydict({"index": pa.array([*index, -1], pa.int64()), "weight": pa.array([*weight, intercept], pa.float64())})

    spread = sample.repartition(max(1, sample.sparkSession.sparkContext.defaultParallelism), "lab_id")
    rows = spread.select("lab_id", "y", extract("text").alias("features")).repartition(1).mapInArrow(run, "index long, weight double").toPandas()
    intercept = rows.weight[rows["index"] == -1].sum()
    if len(rows) == 1 and not intercept:
        intercept = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    rows = rows[rows["index"] >= 0]
    return kind(dim, rows["index"].to_numpy(), rows.weight.to_numpy(dtype=np.float32), float(intercept))


def scorer(model: Model, log_odds: Callable):
    """A column function from a text to the model's probability of class 1."""
    dense: list[np.ndarray] = []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not dense:  # once for each task
            dense.append(model.dense())
        z = np.fromiter((log_odds(t, dense[0], model.intercept) for t in texts), dtype=np.float64, count=len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return run
