"""From documents to training sequences: toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoin.llm import decontamination, packing, simhash, toxicity
from quoin.llm.common import read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled rows outside its held-out fold, scores under 0.5. Null
    texts count as empty and stay, as do rows without id by their texts; equal texts have equal scores, so repeated
    rows stay or go together. An empty table, of documents or of labels, leaves all documents there are."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id, of equals that with the smallest
    fingerprint, then the first read; rows without id come last. Null and empty texts are copies of each other, as
    are repeated rows. An empty table stays empty."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its budget of edits. Null and empty texts stay, repeated
    rows stay or go together; an empty table stays empty, and an empty benchmark leaves all documents."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens. Null texts count as empty; every row
    is packed, repeated ones as often as they come; an empty table gives no pieces."""
    return packing.pack(docs, packing.production())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# Fingerprints, edit distances and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage keeps is written as Parquet to the shared folder and read again."""
    docs, folder = read(spark, sf_dir, "documents"), shared_dir(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
