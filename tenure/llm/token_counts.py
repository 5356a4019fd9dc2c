"""Token counts from flat token files by separator scan.

A flat token file is the documents' ids one after the other, each document ended by the
end-of-document id, without any index. Here it is stored as numbered blocks of little-endian 16- or
32-bit ids, cut without regard to documents. Counting searches each block for the separator
(one vectorised comparison), then stitches the blocks: prefix sums of block lengths and of
separators found, and the last separator before each block, give the start, length and
number of every document. The prefix scan has two levels (blocks in a group, groups in a file), so one
very large file is not one task.

Defined cases: null and empty texts are documents of 0 tokens; ids after the last
separator of a file are a document of their own; an empty file has no documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm import bpe
from tenure.llm.tables import staged

BLOCK_IDS = 1 << 18
GROUP = 1 << 10  # blocks scanned together in the first level


def write_flat(docs: DataFrame, path: str, end_id: int, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` to flat files in the shared folder: (blocks, order of documents).

    One file for each input partition. blocks: (file, block, ids binary); order: (file, first, doc_ids), the
    ids of documents first, first + 1, ... of a file. Strings of special tokens are plain text here, so the
    separator never occurs inside a document. Ids are 16 bits wide if the vocabulary allows, else 32.
    """
    tables = bpe.shared_tables(docs.sparkSession, path)

    def run(batches):
        automaton = bpe.Automaton(bpe.Tables(*tables.value), special=False)
        width = np.dtype("<u2") if automaton.size <= 1 << 16 else np.dtype("<u4")
        name, held, n_held, block, done = None, [], 0, 0, 0

        def rows(ids, numbers, lists, firsts):
            n = len(ids) + len(lists)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([name] * n, pa.int64()),
                "block": pa.array([*numbers, *[None] * len(lists)], pa.int64()),
                "ids": pa.array([*ids, *[None] * len(lists)], pa.binary()),
                "first": pa.array([*[None] * len(ids), *firsts], pa.int64()),
                "doc_ids": pa.array([*[None] * len(ids), *lists], pa.list_(pa.int64())),
            })

        for batch in bpe.small(batches):
            if name is None:
                name = batch.column("at")[0].as_py() >> 33
            doc_ids = batch.column("doc_id").to_pylist()
            yield rows([], [], [doc_ids], [done])
            done += len(doc_ids)
            for pieces in automaton.pieces(batch.column("text").to_pylist()):
                ids = [i for p in pieces for i in p[0]]
                ids.append(end_id)
                held.append(np.array(ids, dtype=width))
                n_held += len(ids)
                if n_held >= 4 * block_ids:
                    flat = np.concatenate(held)
                    full = n_held // block_ids
                    yield rows([flat[i * block_ids : (i + 1) * block_ids].tobytes() for i in range(full)], range(block, block + full), [], [])
                    held, n_held, block = [flat[full * block_ids :]], n_held - full * block_ids, block + full
        if n_held:
            flat = np.concatenate(held)
            parts = [flat[i : i + block_ids].tobytes() for i in range(0, n_held, block_ids)]
            yield rows(parts, range(block, block + len(parts)), [], [])

    files = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("at")).mapInArrow(
        run, "file long, block long, ids binary, first long, doc_ids array<long>"
    )
    files = staged(files, "flat", "zstd")
    return files.filter("block is not null").select("file", "block", "ids"), files.filter("first is not null").select("file", "first", "doc_ids")


def count_tokens(blocks: DataFrame, end_id: int, bytes_per_id: int) -> DataFrame:
    """(file, document, start, n_tokens) of every document of flat files (file, block, ids binary)."""
    width = "<u2" if bytes_per_id == 2 else "<u4"

    @F.pandas_udf("n long, ends array<int>")
    def scan(payloads: pd.Series) -> pd.DataFrame:
        found = [np.frombuffer(p or b"", dtype=width) for p in payloads]
        return pd.DataFrame({"n": [len(x) for x in found], "ends": [np.flatnonzero(x == end_id).astype(np.int32) for x in found]})

    found = blocks.select("file", "block", F.floor(F.col("block") / GROUP).alias("part"), scan("ids").alias("s"))
    found = found.select("file", "block", "part", "s.n", "s.ends", F.size("s.ends").alias("k"), F.element_at(F.col("s.ends"), -1).alias("last"))
    found = found.withColumn("last", F.when(F.col("k") > 0, F.col("last")))
    here = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = found.withColumn("n_before", F.coalesce(F.sum("n").over(here), F.lit(0))).withColumn("k_before", F.coalesce(F.sum("k").over(here), F.lit(0)))
    inner = inner.withColumn("end_before", F.max(F.col("n_before") + F.col("last")).over(here))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = inner.groupBy("file", "part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("n_before") + F.col("last")).alias("end"), F.max("block").alias("top"))
    groups = groups.withColumn("g_n", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("g_k", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
    groups = groups.withColumn("g_end", F.max(F.col("g_n") + F.col("end")).over(ahead)).withColumn("final", F.max("top").over(Window.partitionBy("file")))
    rows = inner.join(groups.select("file", "part", "g_n", "g_k", "g_end", "final"), ["file", "part"])
    base = F.col("g_n") + F.col("n_before")
    prior = F.coalesce(F.col("g_n") + F.col("end_before"), F.col("g_end"), F.lit(-1))
    ends = F.transform("ends", lambda e: e + base)
    rest = (F.col("block") == F.col("final")) & (base + F.col("n") > F.coalesce(F.when(F.col("k") > 0, base + F.col("last")), prior) + 1)
    ends = F.when(rest, F.concat(ends, F.array(base + F.col("n")))).otherwise(ends)
    rows = rows.select("file", (F.col("g_k") + F.col("k_before")).alias("first"), prior.alias("prior"), ends.alias("ends"))
    rows = rows.select("file", "first", F.concat(F.array("prior"), "ends").alias("starts"), F.posexplode("ends").alias("i", "end"))
    start = F.element_at("starts", F.col("i") + 1) + 1
    return rows.select("file", (F.col("first") + F.col("i")).alias("document"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def document_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``: write flat files, scan them, give the documents their ids again."""
    spec = bpe.read_tables(path)
    end_id = max(spec.special.values(), default=len(spec.labels))
    blocks, order = write_flat(docs, path, end_id)
    counts = count_tokens(blocks, end_id, 2 if len(spec.labels) <= 1 << 16 else 4)
    ids = order.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    ids = ids.select("file", (F.col("first") + F.col("i")).alias("document"), "doc_id")
    return ids.join(counts, ["file", "document"]).select("doc_id", "n_tokens")
