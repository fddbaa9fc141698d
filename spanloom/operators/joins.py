"""Joins that hold where one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_by_count(rows: DataFrame, counted: DataFrame, key: str, n: str, total: int, least: int = 4096, most: int = 10_000) -> DataFrame:
    """``rows`` joined with ``counted`` on ``key``, without the rows of a frequent key in one task.

    ``counted`` has one row a key, and ``n`` says how many of ``rows`` have it, ``total`` at
    most in all. So fewer than ``most`` keys have over ``total / most`` rows: these few are
    broadcast, a list of bounded size, and the others are joined by key.
    """
    limit = max(least, total // most)
    hot = F.broadcast(counted.where(F.col(n) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(counted.where(F.col(n) <= limit), key)
    return rows.join(hot, key).select(cold.columns).unionByName(cold)


def firsts(rows: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """``order`` of the first row of each key, each once; partial minima meet, never a key's rows."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order).distinct()
