"""Bounded labelled samples for the classifiers, and the probability calibration they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.tables import held_out_fold

FOLDS = 4  # crc32(doc_id) % 4 == 2 is held out


def labelled_ids(labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, float]:
    """At most ``per_class`` training ids of each class, and the share of class 1.

    Only rows with an id, a 0/1 label and an id outside the held-out fold count. Repeated
    label rows of one id are one row (its largest label). Ids are taken in the order
    of a seeded hash, so the sample is the same for the same table. The share is over all
    training rows, not the sample.
    """
    train = (
        labels.select(F.col("doc_id").alias("lab_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("lab_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_fold("lab_id", FOLDS))
        .groupBy("lab_id")
        .agg(F.max("y").alias("y"))
    )
    n1, n = train.agg(F.sum("y"), F.count("y")).first()
    order = [F.xxhash64("lab_id", F.lit(seed)), F.col("lab_id")]
    picks = [train.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return picks[0].unionByName(picks[1]), (n1 or 0) / n if n else 0.5


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, float]:
    """(text, y) of the sample of ``labelled_ids``: at most 2 x ``per_class`` ids, hence the broadcast."""
    ids, share = labelled_ids(labels, label, per_class, seed)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("lab_id"))
    # Repeated document rows of an id: one of them, the smallest text.
    return joined.groupBy("lab_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), share
