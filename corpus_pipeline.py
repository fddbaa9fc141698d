"""Corpus pipeline: quality rules, quality classifier, near-dedup, secret scans, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)`` with ``docs`` in the columns of ``documents``
and returns a DataFrame; all but the last return those columns. A stage works on every row
that the one before it kept, and its decisions take effect: documents that the rules or
the classifier reject go, one document of each near-duplicate group stays (proposed by
SimHash fingerprints within three bits, as in op6, and by bands; five-word shingles of similarity 0.8 or more decide), secrets are replaced in the texts, and what is left is packed.

Defined results: null and empty texts are rejected by the rules; texts of any length are
taken whole by every stage; repeated rows are one group for near-dedup, and of a group the
smallest doc_id stays, null ids last; an empty table packs to no rows; further columns,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import neardup, packing, repetition, secrets, weak
from spanloom.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # what a worker keeps would stay with it in the stages of a later run
    return packing.pack(packing.pieces(docs, packing.default_vocabulary(), most=100_000))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: suffix arrays, fitted models and near-duplicate groups are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    The files are in the cluster's shared checkpoint folder; a stage's input goes once the
    next stage is written, so that at most two stages' results take up space.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{top}/{k}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
