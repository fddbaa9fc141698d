"""Duplicate removal on streams, with state that outlives the batch and the query's run.

``FirstCopies`` keeps, for each digest, that it has been seen, in Spark's state store: with
``transformWithState`` the state may expire, and a restart from the checkpoint goes on.
``curate`` puts every micro-batch through the whole batch rule: the tables of ``SeenState`` are
its state, a micro-batch is one of its batches, and one that is run again after a failure
replaces what it wrote before, so that the accepted set is that of the rule over the
micro-batches in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from spanloom.checkpoint import cut
from spanloom.functions.digests import normalized_digest
from spanloom.operators.corpus import outcomes
from spanloom.operators.seen import SeenState

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstCopies(StatefulProcessor):
    """The first row of each digest, by ``seq`` within a micro-batch; ``ttl_ms`` ends a digest's memory (null: never)."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seq long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low = min((int(x["seq"].min()) for x in rows), default=None)
        if low is not None and not self.seen.exists():
            self.seen.update((low,))
            yield pd.DataFrame({"digest": [key[0]], "seq": [low]})

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's first row of a digest: few rows of a frequent one go on to its task."""
    for batch in batches:
        least = pa.table(batch).group_by("digest").aggregate([("seq", "min")])
        yield from least.rename_columns(["digest", "seq"]).select(["digest", "seq"]).to_batches()


def first_by_digest(stream: DataFrame, text: str = "text", seq: str = "seq", ttl_ms: int | None = None) -> DataFrame:
    """``(digest, seq)`` of the rows of a stream whose folded text is new; numbers and digests are all that is shuffled.

    Null texts are no copies of each other's and are left out. The session's state store
    has to be RocksDB's (``STORE``), in update or append mode.
    """
    rows = stream.select(normalized_digest(text).alias("digest"), F.col(seq).cast("long").alias("seq")).where("digest is not null")
    rows = rows.mapInArrow(_combined, "digest string, seq long")
    mode = "none" if ttl_ms is None else "processingtime"
    return rows.groupBy("digest").transformWithStateInPandas(FirstCopies(ttl_ms), "digest string, seq long", "append", mode)


def least_by_digest(stream: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """``(digest, seq)``: the least ``seq`` so far of each folded text, by Spark's own aggregation, for update mode.

    A batch gives its digests anew, so the least row of a digest over all batches is the first copy, in whatever
    order files arrive. Nothing is called for a single key; state does not expire (``first_by_digest`` has that).
    """
    rows = stream.select(normalized_digest(text).alias("digest"), F.col(seq).cast("long").alias("seq")).where("digest is not null")
    return rows.groupBy("digest").agg(F.min("seq").alias("seq"))


def curate(
    stream: DataFrame, excluded: DataFrame, folder: str, checkpoint: str, sources: list[str], quotas: dict[str, int] | None = None, held: int = 0,
    order: str = "seq", trigger: dict | None = None, state: SeenState | None = None,
) -> StreamingQuery:
    """Start a query that decides every passage of ``stream(source, passage, order, ...)`` by the whole rule.

    Rows of a micro-batch are taken in the order of ``sources`` and, in a source, of ``order``, a long
    that names a row. ``folder`` gets ``decided/batch=N`` with all outcomes and ``text/batch=N`` with the accepted passages;
    the duplicate state is in ``folder/state``. Quotas and holdout count over all batches.
    """
    own = state or SeenState(stream.sparkSession, f"{folder}/state")
    place = F.create_map(*[F.lit(x) for k, s in enumerate(sources) for x in (s, k)])

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.where(F.col("source").isin(*sources))
        ordered = cut(rows.select(order, "source").withColumn("place", place[F.col("source")]).orderBy("place", order))
        numbers = cut(ordered.select(F.col(order).alias("_order"), "source", F.monotonically_increasing_id().alias("seq")))
        named = rows.withColumnRenamed(order, "_order").join(numbers, ["source", "_order"]).withColumn("document", F.col("seq"))
        told = outcomes(named, excluded, sources, quotas, held, state=own, batch=number)
        told.drop("seq", "document").withColumnRenamed("_order", order).write.mode("overwrite").parquet(f"{folder}/decided/batch={number}")
        taken = told.where("split is not null").select("source", "_order", "split")
        texts = rows.withColumnRenamed(order, "_order").select("source", "_order", "passage").join(taken, ["source", "_order"])
        texts.withColumnRenamed("_order", order).write.mode("overwrite").parquet(f"{folder}/text/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def with_rocksdb(spark: SparkSession, run) -> None:
    """``run()`` while the session's state store is RocksDB's; what was set before is set again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        run()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
