"""Structured-streaming forms of exact duplicate removal and the drop funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import digest, normalize
from spanloom.operators.corpus import stateless_reason


def first_copies(stream: DataFrame, text: str = "text", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose normalised text is new within the watermark; state is bounded by ``delay``."""
    keyed = stream.withColumn("digest", digest(normalize(F.col(text))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def drop_counts(stream: DataFrame, text: str = "text", time: str = "ts", delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Passages by window and stateless drop reason."""
    rows = stream.withColumn("reason", F.coalesce(stateless_reason(F.col(text)), F.lit("accepted")))
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), "reason").count()
