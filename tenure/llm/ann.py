"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are raised by one dimension so that nearness in it is inner product (x, sqrt(M^2 - |x|^2)
with the largest norm M; queries get 0), projected to ``DIMS`` seeded orthogonal directions and
shifted, once for each of ``CURVES`` curves; the Hilbert order of the shifted grid cells is the key of a
curve. All rows are range-partitioned by key into ``CELLS`` cells of about equal size on each curve. A query
looks at the cells within a window around its own on each curve; candidates are reranked by the
exact inner product, and the lists of all cells merge.

The window is fitted: for ``FIT_QUERIES`` queries the true neighbours are found by brute force over all
rows, and the number of curves and the window are the cheapest pair that holds ``TARGET`` of them. Vectors
without structure (independent directions) need windows of most of the curve, which the fit then finds;
clustered vectors need few cells. The rows and the queries of each cell of each curve are counted: a cell of more
than ``SLICE`` rows is searched in slices, and one of more than ``QUERIES`` queries in blocks of queries.
Equal vectors share all their keys and so one cell; a slice compares only as many of them as can be in a result.

Defined cases: vectors null, zero, of another length than most, or holding null or
non-finite components take no part; rows of the query's own vec_id are not its candidates; a repeated
query row is one query; ties go to the smaller vec_id; fewer candidates than k are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
CURVES = 4
DIMS = 6
BITS = 8
CELLS = 64
SLICE = 100_000
QUERIES = 100_000
PAIRS = 1 << 22  # scores held at once
GATHER = 1 << 16  # vectors gathered at once for their exact scores
FIT_SAMPLE = 4096
FIT_QUERIES = 128
TARGET = 0.97


def hilbert_key(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``grid`` (whole numbers below 2^bits).

    Gray-code form: undo the excess turns of the axes from the top bit down, Gray-decode
    across the axes, then interleave the bits.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projection, shift and scale of each curve, fitted on a bounded sample; keys and cells of vectors."""

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.norm = norm
        raised = self.raised(sample, False)
        dims = min(DIMS, raised.shape[1])
        self.turns, self.low, self.step = [], [], []
        for _ in range(CURVES):
            turn = np.linalg.qr(rng.standard_normal((raised.shape[1], dims)))[0]
            at = raised @ turn
            low, high = at.min(axis=0), at.max(axis=0)
            span = np.maximum(high - low, 1e-12)
            self.turns.append(turn)
            self.low.append(low - span * (0.05 + 0.5 * rng.random(dims)))  # the shift
            self.step.append(span * 1.6 / (1 << BITS))
        self.cuts: list[np.ndarray] = []

    def raised(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, extra))

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One column of keys for each curve."""
        r = self.raised(x, query)
        out = [hilbert_key(np.clip((r @ t - low) / step, 0, (1 << BITS) - 1)) for t, low, step in zip(self.turns, self.low, self.step)]
        return np.stack(out, axis=1)

    def cells(self, x: np.ndarray, query: bool) -> np.ndarray:
        keys = self.keys(x, query)
        return np.stack([np.searchsorted(c, keys[:, i], side="left") for i, c in enumerate(self.cuts)], axis=1).astype(np.int32)


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as float64 rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in chunks] or [np.empty((0, dim))]).astype(np.float64)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that take part, and their length."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ok = ok & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").filter(ok)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dim = sizes.d if sizes else 1
    return rows.filter(F.size("embedding") == dim), dim


def _spared(x: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> np.ndarray:
    """Places of the rows that can be among the k best of some query.

    Equal vectors have equal scores, so of one vector only rows with the smallest ids come into question: k rows of an
    id, and 2 k in all, since the query's own id (at most k of them) does not count. ``more`` are further columns that
    must be equal too.
    """
    parts = [np.ascontiguousarray(x).view(np.uint64), *(m.astype(np.uint64) for m in more)]
    bits = np.concatenate([p.reshape(len(x), -1) for p in parts], axis=1)
    mark = (bits * np.random.default_rng(9).integers(1, 1 << 63, bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    order = np.lexsort((ids, mark))
    same = mark[order][1:] == mark[order][:-1]
    pair = np.flatnonzero(same)
    for i in range(0, len(pair), GATHER):  # equal marks of unequal vectors only end a run early
        at = pair[i : i + GATHER]
        same[at] = (bits[order[at]] == bits[order[at + 1]]).all(axis=1)
    alike = np.concatenate(([False], same))
    repeated = alike & np.concatenate(([False], ids[order][1:] == ids[order][:-1]))

    def place(inside: np.ndarray) -> np.ndarray:  # in its run
        n = np.arange(len(inside))
        return n - np.maximum.accumulate(np.where(inside, 0, n))

    few = place(repeated) < k
    # Of the rows left, the number of those before in the run of equal vectors.
    n = np.cumsum(few) - few
    start = np.maximum.accumulate(np.where(alike, 0, np.arange(len(alike))))
    return np.sort(order[few & (n - n[start] < 2 * k)])


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of ``x``, score) of each query's k best of ``x``, exact and with all ties of the last place settled by id."""
    out = []
    step = max(1, min(256, PAIRS // max(1, len(x))))
    for at in range(0, len(q), step):
        rough = q[at : at + step] @ x.T
        barred = q_ids[at : at + step, None] == ids[None, :]
        if allowed is not None:
            barred |= ~allowed(slice(at, at + step))
        rough[barred] = -np.inf
        if x.shape[0] > k:
            edge = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k]
        else:
            edge = np.full(len(rough), -np.inf)
        # Rounding differs between a matrix product and a plain sum; rows this close are settled by the latter.
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        row, col = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
        pieces = [slice(i, i + GATHER) for i in range(0, len(row), GATHER)]
        score = np.concatenate([(q[at + row[i]] * x[col[i]]).sum(axis=1) for i in pieces] or [np.empty(0)])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = place < k
        out.append((row[keep] + at, col[keep], score[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _top(found: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)


def brute_force(rows: DataFrame, dim: int, queries: list, curves: Curves, k: int = K) -> DataFrame:
    """(query_id, cells) of the exact neighbours of a bounded list of (vec_id, vector): every partition of rows, then the best of all."""
    q_ids = np.array([i for i, _ in queries], dtype=np.int64)
    q = np.array([v for _, v in queries], dtype=np.float64)

    def run(batches):
        for batch in batches:
            x, ids = _matrix(batch.column("embedding"), dim), batch.column("vec_id").to_numpy()
            if not len(x):
                continue
            kept = _spared(x, ids, k)
            x, ids = x[kept], ids[kept]
            i, col, score = _best(q, q_ids, x, ids, k)
            cells = curves.cells(x, False)[col]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[i]), "vec_id": pa.array(ids[col], pa.int64()), "score": pa.array(score), "cells": pa.array(list(cells), pa.list_(pa.int32()))})

    return _top(rows.mapInArrow(run, "query_id long, vec_id long, score double, cells array<int>"), k, "cells")


def fit(rows: DataFrame, dim: int, queries: DataFrame, k: int = K) -> tuple[Curves, int, int]:
    """(curves, number to use, window in cells). The sample and the fitted queries are bounded; cuts and neighbours come from all rows."""
    order = [F.xxhash64("vec_id", F.lit(3)), "vec_id"]
    sample = np.array([r.embedding for r in rows.orderBy(*order).limit(FIT_SAMPLE).collect()], dtype=np.float64).reshape(-1, dim)
    norm = rows.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).first()[0] or 1.0
    curves = Curves(sample if len(sample) else np.ones((1, dim)), float(norm) ** 0.5)

    def keys(batches):
        for batch in batches:
            found = curves.keys(_matrix(batch.column("embedding"), dim), False)
            yield pa.RecordBatch.from_pydict({f"k{i}": pa.array(found[:, i]) for i in range(CURVES)})

    shares = [i / CELLS for i in range(1, CELLS)]
    cuts = rows.select("embedding").mapInArrow(keys, ", ".join(f"k{i} long" for i in range(CURVES)))
    cuts = cuts.agg(*[F.percentile_approx(f"k{i}", shares, F.lit(100 * CELLS)).alias(f"k{i}") for i in range(CURVES)]).first()
    curves.cuts = [np.array(c or [0] * (CELLS - 1), dtype=np.int64) for c in cuts]
    asked = [(r.vec_id, r.embedding) for r in queries.orderBy(*order).limit(FIT_QUERIES).collect()]
    if not asked:
        return curves, 1, CELLS
    near = brute_force(rows, dim, asked, curves, k).select("query_id", "cells").collect()  # at most FIT_QUERIES x k rows
    if not near:
        return curves, 1, CELLS
    at = dict(zip([i for i, _ in asked], curves.cells(np.array([v for _, v in asked], dtype=np.float64), True)))
    gap = np.abs(np.array([at[r.query_id] for r in near]) - np.array([r.cells for r in near]))
    best = (CELLS, 1, CELLS)
    for use in range(1, CURVES + 1):
        window = int(np.quantile(gap[:, :use].min(axis=1), TARGET, method="higher"))
        best = min(best, (min(use * (2 * window + 1), CELLS * use), use, window))
    return curves, best[1], best[2]


def _counted(rows: DataFrame) -> np.ndarray:
    """Number of rows of each cell (column) of each curve (row)."""
    out = np.zeros((CURVES, CELLS), dtype=np.int64)
    for r in rows.groupBy("curve", "cell").count().collect():
        out[r.curve, r.cell] = r["count"]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row (vec_id, embedding)."""
    rows, dim = usable(vectors)
    asked, _ = usable(queries)
    asked = asked.filter(F.size("embedding") == dim).dropDuplicates(["vec_id"])
    curves, use, window = fit(rows, dim, asked, k)

    def cells(query: bool):
        @F.pandas_udf("array<int>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(curves.cells(np.stack(x.to_numpy()).astype(np.float64), query)))

        return run("embedding")

    seen = F.posexplode(F.slice("cells", 1, use)).alias("curve", "cell")
    rows = rows.withColumn("cells", cells(False)).withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    rows = rows.select("vec_id", "embedding", "cells", "deal", seen)
    asked = asked.withColumn("cells", cells(True)).withColumn("deal", F.xxhash64("vec_id", F.lit(7)))
    asked = asked.select("vec_id", "embedding", "cells", "deal", seen)
    held, asks = _counted(rows), _counted(asked)
    asks = np.stack([asks[:, max(0, c - window) : c + window + 1].sum(axis=1) for c in range(CELLS)], axis=1)
    slices, blocks = (F.element_at(F.lit(np.maximum(1, -(-n // most)).ravel().tolist()), F.col("curve") * CELLS + F.col("cell") + 1) for n, most in ((held, SLICE), (asks, QUERIES)))
    rows = rows.withColumn("slice", F.pmod("deal", slices)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    near = F.sequence(F.greatest(F.col("cell") - window, F.lit(0)), F.least(F.col("cell") + window, F.lit(CELLS - 1)))
    asked = asked.withColumn("cell", F.explode(near))
    asked = asked.withColumn("block", F.pmod("deal", blocks)).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    rows, asked = rows.drop("deal"), asked.drop("deal")

    def run(key, mine, asks):
        curve = key[0].as_py()
        x, q = _matrix(mine["embedding"], dim), _matrix(asks["embedding"], dim)
        at, to = (_matrix(t["cells"], CURVES).astype(np.int32)[:, :curve] for t in (mine, asks))
        own = mine["vec_id"].to_numpy()
        if len(x):
            kept = _spared(x, own, k, at)
            x, own, at = x[kept], own[kept], at[kept]

        def allowed(part):  # pairs that no earlier curve has shown
            out = np.ones((len(to[part]), len(at)), dtype=bool)
            for c in range(curve):
                out &= np.abs(to[part, c][:, None] - at[None, :, c]) > window
            return out

        if not len(x) or not len(q):
            i, col, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            i, col, score = _best(q, asks["vec_id"].to_numpy(), x, own, k, allowed if curve else None)
        return pa.table({"query_id": pa.array(asks["vec_id"].to_numpy()[i], pa.int64()), "vec_id": pa.array(own[col], pa.int64()), "score": pa.array(score, pa.float64())})

    by = ["curve", "cell", "slice", "block"]
    found = rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")
    return _top(found, k)
