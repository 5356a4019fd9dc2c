"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprint: 64 bits; a bit is 1 if it is set in more than half of the XXH64 values (seed 42) of
the text's 3-word shingles. Two fingerprints link at ``MAX_BITS`` or fewer differing bits.

Search. Equal fingerprints are one node from the start, so copies never meet as pairs.
Fingerprints that differ in at most d bits agree in at least one of d + 1 blocks of bits, so each
distinct fingerprint goes to the d + 1 buckets (block, value of the block). A bucket is
a hierarchical index: its fingerprints in Gray-code order, in which neighbours share most bits;
runs of ``FAN`` entries form a node that holds the bits all of them agree on (a masked pattern),
runs of nodes form upper nodes, and a child keeps only the bits its parent has not fixed. A
query walks down adding up its differences from the masked patterns and leaves a
whole subtree when the sum exceeds d. The walk is exact. A pair is reported in the first block in
which it agrees. Buckets of more than ``SLICE`` rows are cut into slices, and every pair of
slices is a task of its own; the table of such buckets has at most (d + 1) * 2^(64 / (d + 1)) rows.

Defined cases: null and empty texts, and texts of white space, have fingerprint 0, which links like
any other; fewer than 3 words are one shingle; repeated rows are copies; rows with a null doc_id
take part, and a component without any doc_id has a null component_id.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.components import components
from tenure.llm.tables import free_name, staged

WORDS = 3
MAX_BITS = 3
SEED = 42
FAN = 8
SLICE = 100_000
QUERIES = 8192  # queries walked at once

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        found = [b" ".join(found)]
    else:
        found = map(b" ".join, zip(*(found[i:] for i in range(words))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """Fingerprint of each text as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, words, seed) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(out.view(np.int64))

    # As a join key it would be checked for null by a second evaluation, in a second Python worker of each task.
    return run.asNondeterministic()(text)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray-code order, as a long that sorts like the unsigned place."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


class GrayIndex:
    """A forest over ``fps``: one tree for each run of equal ``group``; each run is in Gray order."""

    def __init__(self, group: np.ndarray, fps: np.ndarray) -> None:
        self.fps = fps
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # pattern, mask, first child, end child
        ones, anys, run = fps, fps, group
        while True:
            edge = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            place = np.arange(len(run)) - np.repeat(edge, np.diff(np.append(edge, len(run))))
            first = np.flatnonzero(place % FAN == 0)
            ones, anys, run = np.bitwise_and.reduceat(ones, first), np.bitwise_or.reduceat(anys, first), run[first]
            mask = ~(ones ^ anys)
            self.levels.append((ones & mask, mask, first, np.append(first[1:], len(place))))
            if len(run) == len(edge):
                break
        self.levels.reverse()
        self.roots = run  # the group of each root

    def walk(self, queries: np.ndarray, roots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of all entries within ``most`` bits under root ``roots[i]`` of query i."""
        q, node = np.arange(len(queries)), roots
        pattern, mask, first, end = self.levels[0]
        gone = np.bitwise_count((queries ^ pattern[node]) & mask[node]).astype(np.int16)
        for depth in range(1, len(self.levels) + 1):
            keep = gone <= most
            q, node, gone = q[keep], node[keep], gone[keep]
            n = end[node] - first[node]
            child = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            fixed = np.repeat(mask[node], n)
            q, gone = np.repeat(q, n), np.repeat(gone, n)
            if depth < len(self.levels):
                pattern, mask, first, end = self.levels[depth]
                gone = gone + np.bitwise_count((queries[q] ^ pattern[child]) & mask[child] & ~fixed)
            else:  # the entries: all bits that no node above has fixed
                gone = gone + np.bitwise_count((queries[q] ^ self.fps[child]) & ~fixed)
            node = child
        keep = gone <= most
        return q[keep], node[keep]


def _links(group: np.ndarray, side: np.ndarray, block: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside each run of equal ``group``; side 1 rows are queries only, side 0 rows entries, 2 both."""
    width = 64 // (most + 1)
    entry = np.flatnonzero(side != 1)
    index = GrayIndex(group[entry], fps[entry])
    asks = np.flatnonzero((side != 0) & np.isin(group, index.roots))
    found_a, found_b = [], []
    for i in range(0, len(asks), QUERIES):
        ask = asks[i : i + QUERIES]
        q, e = index.walk(fps[ask], np.searchsorted(index.roots, group[ask]), most)
        a, b = ask[q], entry[e]
        keep = (a < b) | (side[a] == 1)
        a, b = a[keep], b[keep]
        differ = fps[a] ^ fps[b]
        # The lowest block without a differing bit reports the pair.
        first = np.full(len(a), most + 1)
        for k in range(most, -1, -1):
            bits = np.uint64((1 << (64 - k * width if k == most else width)) - 1)
            first[(differ >> np.uint64(k * width)) & bits == 0] = k
        keep = first == block[a]
        found_a.append(fps[a[keep]])
        found_b.append(fps[b[keep]])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, np.uint64),) * 2


def links(nodes: DataFrame, most: int = MAX_BITS, slice_rows: int = SLICE) -> DataFrame:
    """(a, b) for every pair of distinct fingerprints (column fp of ``nodes``) within ``most`` bits, once."""
    width = 64 // (most + 1)
    starts = [k * width for k in range(most + 1)]
    blocks = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << width) - 1 if k < most else (1 << (64 - s)) - 1)).alias("value"))
        for k, s in enumerate(starts)
    ])
    rows = nodes.select("fp", gray_rank(F.col("fp")).alias("place"), F.inline(blocks))
    # At most (most + 1) * 2^width keys, and only those of large buckets: a bounded broadcast.
    large = rows.groupBy("block", "value").count().filter(F.col("count") > slice_rows)
    large = large.select("block", "value", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices"))
    rows = rows.join(F.broadcast(large), ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("slices", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("other")
    rows = rows.select("fp", "place", "block", "value", own.alias("own"), other)
    rows = rows.select(
        "fp", "place", "block", "value",
        F.least("own", "other").alias("s1"), F.greatest("own", "other").alias("s2"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    keys = ["block", "value", "s1", "s2"]

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows_held = 0

        def flush(part: pa.Table):
            cols = {c: part.column(c).to_numpy() for c in (*keys, "side", "fp")}
            change = np.zeros(part.num_rows, dtype=bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            group = np.cumsum(change)
            several = np.bincount(group)[group] > 1
            if several.any():
                a, b = _links(group[several], cols["side"][several], cols["block"][several], cols["fp"][several].astype(np.int64).view(np.uint64), most)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= 2 * slice_rows:
                part = pa.Table.from_batches(held)
                last = [part.column(k)[-1].as_py() for k in keys]
                same = np.ones(part.num_rows, dtype=bool)
                for k, v in zip(keys, last):
                    same &= part.column(k).to_numpy() == v
                cut = int(np.argmax(same))  # the last bucket may go on in the next batch
                if cut:
                    yield from flush(part.slice(0, cut))
                held, rows_held = part.slice(cut).to_batches(), part.num_rows - cut
        if rows_held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS, most: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp) of each row, (fp, root, component_id) of each distinct fingerprint)."""
    rows = staged(docs.select("doc_id", fingerprints(F.col("text"), words).alias("fp")), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes.select("fp"), most))
    nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    nodes = nodes.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull(), "low", "fp")).alias("first"))
    return rows, nodes.join(least, "root").select("fp", "root", "component_id", F.col("first.fp").alias("first_fp"), F.col("first.low").alias("first_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row of ``docs``."""
    rows, nodes = grouped(docs, words, most)
    return rows.join(nodes.select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, most: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component, all its columns kept: that of the smallest doc_id.

    Of repeated rows of that id, and of components whose rows all lack an id, the smallest row stays.
    """
    _, nodes = grouped(docs, words, most)
    keep = nodes.filter(F.col("fp") == F.col("first_fp")).select(F.col("fp").alias("kept_fp"), F.col("first_id").alias("kept_id"))
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), fingerprints(F.col("text"), words).alias(fp))
    marked = marked.join(keep, (F.col(fp) == F.col("kept_fp")) & F.col(f"{row}.doc_id").eqNullSafe(F.col("kept_id")))
    return marked.groupBy("kept_fp", "kept_id").agg(F.min(row).alias(row)).select(f"{row}.*")
