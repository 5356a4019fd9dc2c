"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are the runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. A document's score
for an item (a query text) is the sum over the item's distinct terms of the term's impact in it,

    w * ((10^9 tf) div (1000 tf + 8 m)),  w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 10 + (90 n N) div L,

with N documents that have a term, L terms in all of them, n in the document, df documents with the term, tf
its occurrences in the document.

The documents are read once for the counts: every row becomes its n and the (term, tf) pairs of the items'
terms, written to the shared folder. Each task then takes its rows in shards of bounded size, and sorts a
shard's pairs into one impact list a term, highest first, with the place of every (document, term) for direct
access. For an item, the first unseen positions of its lists are read; each document found there gets its
whole score by direct accesses to all lists, which marks its positions in them as seen. A list's best
position is the end of its contiguous run of seen positions, so it often lies well past what was read. No unseen
document can score above the sum of the impacts just after the best positions; once that is strictly
below the k-th best score (equal scores are still settled by id), the item's search in the shard ends. The k-th
score so far goes on to the next shard of the task. A task returns k rows an item, merged in two steps.

The items' terms are sent to the tasks. Items are searched in blocks of about ``PAIRS`` (item, term) pairs, one
after another, so what is sent has a fixed size and any number of items is answered.

Defined cases: null and empty texts have no terms, items without terms and items that no document scores above 0
for have no rows; every row is a document of its own, repeated rows and ids too; rows of one item id are one
item with the terms of all of them; a null id sorts last among equal scores; fewer than k documents give
fewer rows; extra columns are left out. Texts of any length are read whole, in pieces that end between terms.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.tables import staged

K = 10
PAIRS = 1 << 15  # (item, term) pairs searched for at once
CELLS = 1 << 24  # documents x terms of a shard
LEAST_ROWS = 64
STEP = 8  # positions read at once in each list at first; doubled from round to round
PIECE = 1 << 20
ROWS = 256
BUCKETS = 64

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TERM_BYTES = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_pieces(text: bytes | None):
    """The terms of a text (UTF-8), in lists of about ``PIECE`` bytes."""
    data, at = (text or b"").translate(_TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _item_pairs(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                terms = sorted({t for piece in term_pieces(text) for t in piece})
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(terms), pa.int64()), "term": pa.array(terms, pa.binary())})

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term: its length, and which of ``terms`` it holds how often."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches):
        number = shared.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                sizes, found = [], []
                for text in rows.column("text").to_pylist():
                    n, count = 0, Counter()
                    for piece in term_pieces(text):
                        n += len(piece)
                        count.update(map(number, piece))
                    count.pop(None, None)
                    sizes.append(n)
                    found.append(sorted(count.items()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "n": pa.array(sizes, pa.int64()),
                    "ids": pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                    "tfs": pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64())),
                })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>").filter("n > 0")


class Best:
    """The ``k`` best (score, id) so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.missing, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def add(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray) -> None:
        score, missing, doc_id = (np.concatenate(x) for x in ((self.score, score), (self.missing, missing), (self.id, doc_id)))
        first = np.lexsort((doc_id, missing, -score))[: self.k]
        self.score, self.missing, self.id = score[first], missing[first], doc_id[first]

    def beats(self, bound: int) -> bool:
        """Whether no document that scores at most ``bound`` can get in."""
        return bound <= 0 or (len(self.score) == self.k and bound < self.score[-1])


class Shard:
    """Impact lists of some documents, and the place of each (document, term) in its list."""

    def __init__(self, doc_id: np.ndarray, missing: np.ndarray, length: np.ndarray, ids: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.doc_id, self.missing = doc_id, missing
        spread = 10 + np.array([90 * int(n) * n_docs // n_terms for n in length], dtype=np.int64)
        doc = np.repeat(np.arange(len(doc_id)), sizes)
        impact = weight[ids] * ((10**9 * tfs) // (1000 * tfs + 8 * spread[doc]))
        doc, ids, impact = doc[impact > 0], ids[impact > 0], impact[impact > 0]
        order = np.lexsort((-impact, ids))
        doc, ids = doc[order], ids[order]
        self.doc, self.impact = doc, np.append(impact[order], 0)
        self.size = np.bincount(ids, minlength=len(weight))
        self.start = np.cumsum(self.size) - self.size
        self.place = np.zeros((len(doc_id), len(weight)), dtype=np.int32)  # from 1; 0: not in the list
        self.place[doc, ids] = np.arange(len(doc)) - self.start[ids] + 1

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Put the shard's documents among ``best``; returns how many documents were looked at."""
        terms = terms[self.size[terms] > 0]
        start, size = self.start[terms], self.size[terms]
        first = np.cumsum(size + 1) - size - 1  # of each list in ``unseen``; the place after a list's end stays unseen
        unseen = np.ones(int((size + 1).sum()), dtype=bool)
        known = np.zeros(len(self.doc_id), dtype=bool)
        at, step = np.zeros(len(terms), dtype=np.int64), STEP  # best positions: all before are seen
        while True:
            left = at < size
            if best.beats(int(self.impact[(start + at)[left]].sum())):
                return int(known.sum())
            reads = [self.doc[s + a : s + min(a + step, z)] for s, a, z in zip(start[left].tolist(), at[left].tolist(), size[left].tolist())]
            docs = np.unique(np.concatenate(reads))
            docs = docs[~known[docs]]
            known[docs] = True
            place = self.place[docs][:, terms]
            score = self.impact[np.where(place > 0, start + place - 1, -1)].sum(axis=1)
            unseen[(first + place - 1)[place > 0]] = False
            best.add(score, self.missing[docs], self.doc_id[docs])
            at += [int(unseen[f + a : f + z + 1].argmax()) for f, a, z in zip(first.tolist(), at.tolist(), size.tolist())]
            step *= 2


def _shards(batches, rows: int):
    """Columns of ``rows`` rows at a time, from Arrow batches."""
    kept, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            kept.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _search_block(found: DataFrame, queries: dict, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of a block: {item_id: its term numbers}."""
    items, lists = list(queries), list(queries.values())
    rows_at_once = max(LEAST_ROWS, CELLS // max(len(weight), 1))

    def run(batches):
        best = [Best(k) for _ in items]
        for table in _shards(batches, rows_at_once):
            ids, tfs = table.column("ids").combine_chunks(), table.column("tfs").combine_chunks()
            ids, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, tfs))
            doc_id = table.column("doc_id")
            shard = Shard(
                doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(), table.column("n").to_numpy(), ids.flatten().to_numpy(zero_copy_only=False),
                tfs.flatten().to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy()), weight, n_docs, n_terms,
            )
            for terms, b in zip(lists, best):
                shard.search(terms, b)
        for i, b in enumerate(best):
            yield pa.RecordBatch.from_pydict({"item": pa.array([i] * len(b.id), pa.int32()), "doc_id": pa.array(b.id, pa.int64(), mask=b.missing), "score": pa.array(b.score, pa.int64())})

    rows = found.filter(F.size("ids") > 0).mapInArrow(run, "item int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    for keys in (["item", "bucket"], ["item"]):  # two steps: no task merges the rows of all tasks for an item
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = F.array(*[F.lit(i).cast("long") for i in items])
    return rows.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    pairs = staged(_item_pairs(items), "ranked-items")
    blocks = -(-pairs.count() // PAIRS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        terms = sorted({bytes(r.term) for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        found = staged(postings(docs, terms), "ranked-postings")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(terms), dtype=np.int64)
        for r in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # at most a row a term
            weight[r["id"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        queries: dict = {}
        for r in sorted(rows, key=lambda r: (r.item_id is not None, r.item_id, r.term)):
            if weight[number[bytes(r.term)]]:
                queries.setdefault(r.item_id, []).append(number[bytes(r.term)])
        if queries:
            out = out.unionByName(_search_block(found, {i: np.array(t) for i, t in queries.items()}, weight, n_docs, n_terms, k))
    return out
