"""A training corpus from `documents` in five stages, each one of the operators in ``tenure.llm``.

Every stage gets its predecessor's rows, written as Parquet in the shared folder and read again, and
returns the columns of its input; the last returns one row of digests for each row left.

- toxicity: rows whose text scores ``toxicity.THRESHOLD`` or more go.
- quality: rows whose text scores below ``quality_classifier.THRESHOLD`` go.
- simhash: of each group of near-duplicates the row with the smallest doc_id stays.
- mixing: rows as often as the target weights take them (0 to ``mixing.MAX_EPOCHS`` times).
- bpe: token count and digests of ids and decoded text.

Nulls, empty texts, repeated rows, empty tables and extra columns are as each operator defines them;
extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import bpe, mixing, quality_classifier, simhash, toxicity
from tenure.llm.queries import VOCABULARY
from tenure.llm.tables import free_name, staged, table


def _kept(spark: SparkSession, docs: DataFrame, sf_dir: str, classifier, keep) -> DataFrame:
    """Rows whose score ``keep`` accepts; the classifier learns from the labelled rows of ``documents``."""
    model = classifier.train(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return docs.withColumn(score, classifier.score(F.col("text"), model)).filter(keep(F.col(score))).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, sf_dir, toxicity, lambda s: s < toxicity.THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(spark, docs, sf_dir, quality_classifier, lambda s: s >= quality_classifier.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).drop(*mixing.mixed_names(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None  # trained classifiers and XXH64 fingerprints are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
