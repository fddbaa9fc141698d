"""Queries that call the table functions from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import tables
from spanloom.plans import annotation, derived as D  # noqa: F401
from spanloom.plans.registry import ORACLES, query


@query("token_windows_by_sql", ORACLES["token_windows"])
def token_windows_by_sql(spark, d):
    """A row of the table stands for all of a document's tokens, which Spark counts."""
    tables.register(spark)
    tokens = D.tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
    return spark.sql("SELECT * FROM token_windows(TABLE({tokens}) PARTITION BY (doc_id), 128, 30)", tokens=tokens)


@query("passages_by_sql")
def passages_by_sql(spark, d):
    """The same rows as ``split_passages``; no SQL for the choice of blocks."""
    tables.register(spark)
    return spark.sql("SELECT * FROM passages(TABLE({docs}), 2000)", docs=D.docs(spark, d).select("doc_id", "text"))


@query(
    "packed_by_source",
    """WITH sizes AS (SELECT source, doc_id AS seq, len(regexp_extract_all(text, '[^\\s\\x{00A0}]+'))::BIGINT AS n FROM documents),
    o AS (SELECT seq, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM sizes)
    SELECT seq, block, greatest(off, block * 510) - off AS "from", least(off + n, (block + 1) * 510) - off AS "to"
    FROM (SELECT *, unnest(range(off // 510, (off + n - 1) // 510 + 1)) AS block FROM o WHERE n > 0)""",
)
def packed_by_source(spark, d):
    tables.register(spark)
    sizes = D.docs(spark, d).select("source", F.col("doc_id").alias("seq"), F.size(T.words(F.col("text"))).cast("long").alias("n_tokens"))
    return spark.sql("SELECT * FROM packed(TABLE({sizes}) PARTITION BY (source) ORDER BY (seq), 510)", sizes=sizes)
