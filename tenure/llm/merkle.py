"""Merkle dataset manifest: roots and inclusion proofs by incremental witnesses.

Rows are leaves; those of one group (``tree``) ascend by their key and make a binary tree: while a tree has
several nodes, every two consecutive ones become H of both, a last single one H of itself. The subroots,
by group (null first, then by UTF-8 bytes), make the tree above in the same way. H is the lowercase
hex SHA-256 of its inputs joined, digests as hex text. A leaf is H of its fields, each ``-`` if null,
else UTF-8 byte count, ``:``, value.

Leaves are appended one after another. A finished subtree that waits for its right sibling is open, and holds
the partial witnesses of its leaves; when the sibling is done, each side's root extends the witnesses of the
other side, and both become one open subtree. Work is dealt out in aligned blocks of ``BLOCK`` leaves:
a block is appended to in one task, and the roots of the blocks are appended in the same way, in
blocks of ``BLOCK`` again, until each tree has one root. A leaf's witness is that of its block's tree,
followed by that of the block among the blocks, and so on up to the root: sibling digests in order, 32 bytes each.

Positions come from range partitions of the keys and counts of each (partition, group), so a group of any
size, however hot, is spread over tasks, and no block, group or table is gathered in one place. Leaves and
blocks are written to the shared folder between rounds: a lost executor costs its running tasks.

Defined cases: null keys come first; equal keys are ordered by leaf, so repeated rows are neighbours with equal
leaves; a null group is a group of its own; an empty table gives no rows; a lone leaf is its subroot, and a lone
subroot is the root; extra columns of the documents are left out unless named as fields. Texts of any length are
hashed whole.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.tables import held_out_fold, shuffle_parts, staged

LEVELS = 12
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*digests: bytes) -> bytes:
    """H of digests, as 32 bytes."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf(values: list[Column]) -> Column:
    """H of field values, as hex text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Appender:
    """Aligned append of nodes from the left: open subtrees, and the witness of every node so far."""

    def __init__(self) -> None:
        self.open: dict[int, tuple[bytes, int, int]] = {}  # by height: root, first and last + 1 of its nodes
        self.witness: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._rise(0, (digest, at, at + 1), None)

    def _rise(self, height: int, tree: tuple[bytes, int, int], top: int | None) -> tuple[int, tuple[bytes, int, int]]:
        """``tree`` meets open left siblings as long as there are some, and stays open above them."""
        while height != top and height in self.open:
            left, right = self.open.pop(height), tree
            for side, other in ((left, right), (right, left)):
                for i in range(side[1], side[2]):
                    self.witness[i].append(other[0])
            tree, height = (h(left[0], right[0]), left[1], right[2]), height + 1
        if top is None:
            self.open[height] = tree
        return height, tree

    def close(self, height: int) -> bytes:
        """The root at ``height``: what is open is raised, alone where it has no sibling."""
        low, tree = min(self.open), self.open.pop(min(self.open))
        while low < height:
            if low in self.open:
                low, tree = self._rise(low, tree, height)
            else:
                low, tree = low + 1, (h(tree[0]), tree[1], tree[2])
        return tree[0]


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return (n - 1).bit_length()


def _name(group: Column) -> Column:
    """A group as a key that is never null: null sorts first, others as their UTF-8 bytes."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(nodes: DataFrame, keys: list[Column]) -> DataFrame:
    """``nodes`` (tree, ...) with pos (from 0, by ``keys`` within the tree) and n (nodes of the tree), written.

    The range partitions are written first, in order, so that their counts and rows stay as they are.
    """
    spark = nodes.sparkSession
    spread = nodes.repartitionByRange(shuffle_parts(spark), "tree", *keys).sortWithinPartitions("tree", *keys)
    rows = staged(spread.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "merkle-sorted")
    # A (tree, part) pair is a run of rows; a tree has at most as many runs as there are parts.
    whole = Window.partitionBy("tree")
    runs = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("first"))
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("tree", "part", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("size").over(whole).alias("n"))
    out = rows.join(starts, ["tree", "part"]).withColumn("pos", F.col("row") - F.col("first") + F.col("start"))
    return staged(out.drop("row", "part", "start", "first"), "merkle-numbered")


def _append_blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, ...) with block, the witness in the block, and the block's root in its first row."""

    def run(block: pa.Table) -> pa.Table:
        rows = block.sort_by("pos")
        n, trees = rows.column("n")[0].as_py(), Appender()
        for digest in rows.column("digest").to_pylist():
            trees.append(digest)
        root = trees.close(LEVELS if n > BLOCK else height_of(n))
        rows = rows.append_column("witness", pa.array([b"".join(w) for w in trees.witness], pa.binary()))
        return rows.append_column("root", pa.array([root] + [None] * (rows.num_rows - 1), pa.binary()))

    keyed = nodes.withColumn("block", F.shiftright("pos", LEVELS))
    schema = T.StructType([*keyed.schema, T.StructField("witness", T.BinaryType()), T.StructField("root", T.BinaryType())])
    return keyed.groupBy("tree", "block").applyInArrow(run, schema)


def _forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append ``nodes`` (tree, pos, n, digest, ...).

    Returns ``nodes`` with block and the witness in it, and the blocks (tree, block, n, above, top): the
    witness above each, and the root of its tree.
    """
    found = staged(_append_blocks(nodes), "merkle-blocks")
    roots = found.filter("root IS NOT NULL").select("tree", "block", "n", "root")
    if (nodes.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        blocks = roots.select("tree", "block", "n", F.lit(b"").alias("above"), F.col("root").alias("top"))
    else:
        # The roots of the blocks of each tree are appended in turn; a lone one has no sibling and is the root.
        nodes_above = roots.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("digest"), F.col("n").alias("leaves"))
        upper, tops = _forest(staged(nodes_above, "merkle-roots"))
        joined = upper.join(tops.drop("n"), ["tree", "block"])
        blocks = joined.select("tree", F.col("pos").alias("block"), F.col("leaves").alias("n"), F.concat("witness", "above").alias("above"), "top")
    return found.drop("root"), staged(blocks, "merkle-above")


def steps_of(pos: int, n: int) -> list[bool | None]:
    """For each level above node ``pos`` of ``n``: is the sibling on the left (None: there is none)."""
    out = []
    while n > 1:
        out.append(None if pos == n - 1 and not pos & 1 else bool(pos & 1))
        pos, n = pos >> 1, (n + 1) >> 1
    return out


def fold(digest: bytes, witness: bytes, steps: list[bool | None]) -> bytes:
    """The root that ``digest`` and its witness lead to."""
    at = 0
    for left in steps:
        other = witness[at : at + 32]
        at += 0 if left is None else 32
        digest = h(digest) if left is None else h(other, digest) if left else h(digest, other)
    return digest


def folded(*columns: Column | str) -> Column:
    """``fold`` of a digest and a witness through the leaf's tree (pos, n) and the tree of subroots (tree_pos, trees)."""

    @F.pandas_udf("binary")
    def run(digest: pd.Series, witness: pd.Series, pos: pd.Series, n: pd.Series, tree_pos: pd.Series, trees: pd.Series) -> pd.Series:
        rows = zip(digest, witness, *(c.tolist() for c in (pos, n, tree_pos, trees)))
        return pd.Series([fold(d, w, steps_of(p, k) + steps_of(q, m)) for d, w, p, k, q, m in rows], dtype=object)

    return run(*columns)


def manifest(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Proofs of ``leaves`` (group, digest binary, ...): the rows with pos, n, tree_pos, trees, subroot, root, witness.

    ``group`` names a leaf's tree; ``keys`` order the leaves of a tree, then their digest.
    """
    named = leaves.withColumn("tree", _name(F.col("group"))).drop("group")
    rows, blocks = _forest(numbered(named, [F.col(k) for k in keys] + [F.col("digest")]))
    subroots = blocks.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    upper, tops = _forest(numbered(subroots, [F.col("name")]))
    trees = upper.join(tops.drop("n"), ["tree", "block"]).select(
        F.col("name").alias("tree"), F.col("pos").alias("tree_pos"), F.col("n").alias("trees"), F.col("digest").alias("subroot"),
        F.col("top").alias("root"), F.concat("witness", "above").alias("over"),
    )
    # What lies above a leaf is joined to its block first: a hot group has one row for BLOCK leaves there.
    above = blocks.drop("top", "n").join(trees, "tree").withColumn("above", F.concat("above", "over")).drop("over")
    return rows.join(staged(above, "merkle-trees"), ["tree", "block"]).withColumn("witness", F.concat("witness", "above")).drop("above", "tree", "block")


def proof_digest(witness: Column) -> Column:
    """H of the siblings of a witness, as hex text."""
    return F.sha2(F.lower(F.hex(witness)).cast("binary"), 256)


def verify(docs: DataFrame, tampered: Column, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS, group: str = "lang", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The manifest of ``docs``, and each row's proof checked against a copy of which ``tampered`` rows have ``changed`` values.

    Returns ``keys``, leaf, subroot, root, proof_sha256 (of the rows as they are), folded_root (from the copy's leaf
    and the original siblings), verified, and the proof itself (pos, n, tree_pos, trees, witness).
    """
    values = [F.col(f) for f in fields]
    other = F.when(tampered, leaf([changed.get(f, v) for f, v in zip(fields, values)])).otherwise(F.lit(None))
    leaves = docs.select(*keys, F.col(group).alias("group"), F.unhex(leaf(values)).alias("digest"), F.unhex(other).alias("other"))
    rows = manifest(staged(leaves, "merkle-leaves"), list(keys))
    rows = rows.withColumn("fold", folded(F.coalesce("other", "digest"), "witness", "pos", "n", "tree_pos", "trees"))

    def text(c: str) -> Column:
        return F.lower(F.hex(c))

    return rows.select(
        *keys, text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("witness")).alias("proof_sha256"),
        text("fold").alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"), "pos", "n", "tree_pos", "trees", "witness",
    )


def tampered_fold(key: str = "doc_id") -> Column:
    """True where 7 divides the crc32 of the key as text."""
    return held_out_fold(key, 7, 0)
