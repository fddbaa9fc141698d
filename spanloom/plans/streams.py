"""Queries that run as streams over the tables until all of their rows are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.checkpoint import shared_folder
from spanloom.plans.curation import dig
from spanloom.plans.registry import query
from spanloom.streaming import state


@query("stream_first_copies", f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {dig()}")
def stream_first_copies(spark: SparkSession, d: str) -> DataFrame:
    """First copies of texts by a stateful stream: the smallest id of each digest over all micro-batches."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_parent(d))

    kind = "digest string, seq long"
    spark.createDataFrame([], kind).write.parquet(f"{folder}/out/batch=-1")  # a stream without files has no batch

    def each(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    def run() -> None:
        sink = state.least_by_digest(stream, seq="doc_id").writeStream.outputMode("update").foreachBatch(each)
        sink.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    state.with_rocksdb(spark, run)
    return spark.read.schema(kind).parquet(f"{folder}/out").groupBy("digest").agg(F.min("seq").alias("doc_id")).select("doc_id")


def _parent(d: str) -> str:
    """What a file stream can list: a folder of files, or the one file itself by a pattern."""
    return f"{d}/documents.parque[t]"
