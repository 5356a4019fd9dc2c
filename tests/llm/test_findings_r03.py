"""Sizes and plans that the checks of round 3 found wanting."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tenure.llm import katz, simhash
from tenure.llm.tables import held_out_fold


@pytest.mark.parametrize("dtype", [np.int16, np.int32, np.uint32, np.uint64, np.float64])
def test_packed_arrays_come_back(dtype):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        values = rng.integers(0, 30_000, n).astype(dtype)
        if dtype == np.uint64:
            values *= np.uint64(2**63 // 30_000 * 2)
        if dtype == np.float64:
            values = -values / 7
        assert katz._unpack(katz._pack(values), dtype).tolist() == values.tolist()
        if dtype != np.float64:
            values.sort()
            assert katz._unpack(katz._pack(values, rising=True), dtype, rising=True).tolist() == values.tolist()


@pytest.mark.parametrize("sizes", [(5, 4, 3), (1 << 20, 1 << 30, 7), (1 << 31, 1 << 31, 1 << 31), (1, 1, 1)])
def test_rank_orders_by_all_columns(sizes):
    rng = np.random.default_rng(4)
    columns = [rng.choice([0, size - 1, size // 2], 500) for size in sizes]
    rank = katz._rank(columns, list(sizes))
    got = [tuple(c[i] for c in columns) for i in rank]
    assert got == sorted(zip(*columns)) and sorted(rank.tolist()) == list(range(500))


def _batch(rows):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(5000)]
    share = 1 / np.arange(1, 5001)
    texts = [" ".join(words[i] for i in rng.choice(5000, 300, p=share / share.sum())) for _ in range(rows)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(rows)), "text": texts, "train": [True] * rows, "at": pa.array(range(rows))})


def test_katz_blocks_take_few_bytes_a_token():
    """The arrays of a block as they are shuffled, before Spark's own compression."""
    batch = _batch(400)
    out = pa.Table.from_batches(list(katz._blocks([], 2, 3)([batch])))
    assert out.num_rows == 3
    assert out.nbytes < 12 * 400 * 301


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_katz_tasks_hold_few_bytes_a_token(monkeypatch):
    """Blocks and parts are sorted in pieces; whole, they took 110 and 70 bytes a token here."""
    monkeypatch.setattr(katz, "PIECE", 1 << 14, raising=False)
    batch, tokens = _batch(1000), 1000 * 301
    _, peak = _peak(lambda: [b.num_rows for b in katz._blocks([], 4, 3)([batch])])
    assert peak < 70 * tokens
    part = pa.Table.from_batches(list(katz._blocks([], 1, 3)([batch])))
    part = part.filter(pa.compute.equal(part["part"], 0))
    asked, peak = _peak(lambda: katz._ask([], 1, 3)((pa.scalar(0),), part))
    assert sum(asked["count"][0].as_py()) == tokens and peak < 45 * tokens


def test_katz_ranges_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(katz, "PIECE", 10)
    rng = np.random.default_rng(6)
    for keys, size in ((np.empty(0, np.int32), 3), (np.zeros(50, np.int32), 1), (rng.integers(0, 90, 500), 90), (np.repeat([2, 5, 7], [30, 1, 9]), 9), (np.repeat([0, 4], [3, 40]), 5)):
        found = list(katz._ranges(keys, size))
        assert sorted(np.concatenate([*found, np.empty(0, np.int64)]).tolist()) == list(range(len(keys)))
        assert all(keys[a].max() < keys[b].min() for a, b in zip(found, found[1:]))
        assert all(len(x) - np.count_nonzero(keys[x] == keys[x].max()) < 10 for x in found)


def test_katz_in_small_pieces_is_the_same(spark, docs, odd, monkeypatch):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        assert {length for _, _, length in katz.hot_contexts(rows, 12, 3)} == {1, 2}
        whole = sorted(katz.score_texts(rows, held_out_fold("doc_id", 7)).collect(), key=repr)
        monkeypatch.setattr(katz, "PIECE", 20)
        assert sorted(katz.score_texts(rows, held_out_fold("doc_id", 7)).collect(), key=repr) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_are_evaluated_once_where_rows_are_kept(spark, odd):
    """A second evaluation is a second Python worker in each task, and such workers stay for the stages after."""
    plan = simhash.drop_near_duplicates(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
