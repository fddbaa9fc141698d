"""Dominance counting: divide and conquer on slot ranks, one shuffle by node for each recursion level.

A row is above another if its slot is smaller and its level strictly larger. Rows of one
slot and level are added up first, so that what is divided are distinct pairs of a slot and
a level, however many rows stand behind them. Slots and levels are replaced by their dense
ranks. The recursion halves the slot ranks: at depth ``b`` a node holds the ranks that agree
but for their lowest ``b + 1`` bits, its left half has bit ``b`` clear and its right half set.
Two pairs of different slots are in different halves of exactly one node, so every node
merges its halves by level, takes suffix sums of the left half's counts, and hands each pair
of its right half the sum of all larger levels; a pair's answer is the total over depths.

Suffix sums of a node are taken by digits of the level rank (``DIGIT`` bits each): inside
groups of at most ``2 ** DIGIT`` levels, and over the groups' totals, again by digits. So no
task holds more than such a group at a time, whatever the size of the node.

Defined results: rows with a null slot or level (a level that is not finite counts as null)
are above none and have null counts; a null weight stands for nothing; rows that repeat
count each time; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut, joined_by_count, table
from spanloom.llm.registry import ORACLES, QUERIES

#: bits of a level rank that one pass of suffix sums covers
DIGIT = 6


def dense_ranks(values: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``(column, rank)`` for the distinct values in ascending order from 0, and their number.

    Values are dealt out by range and numbered inside each range; only the ranges' sizes, one
    for each partition, reach the driver.
    """
    held = cut(values.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)).withColumn("part", F.spark_partition_id())
    before, total = {}, 0
    for part, n in sorted(map(tuple, held.groupBy("part").count().collect())):
        before[part], total = total, total + n
    if not before:
        return held.select(column, F.lit(0).cast("long").alias("rank")), 0
    first = F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("part")]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return held.select(column, (first + inside).cast("long").alias("rank")), total


def suffix_sums(totals: DataFrame, bits: int, digit: int = DIGIT) -> DataFrame:
    """``(node, v, above, rows_above)``: the sums of ``n`` and ``rows`` over the node's larger ``v``.

    ``totals`` holds ``node, v, n, rows`` with one row for each node and ``v`` below ``2 ** bits``.
    """
    group = F.shiftright("v", digit).alias("group")
    later = Window.partitionBy("node", "group").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.select("node", group, "v", "n", "rows").select(
        "node", "group", "v", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("above"), F.coalesce(F.sum("rows").over(later), F.lit(0)).alias("rows_above")
    )
    if bits <= digit:
        return inside.drop("group")
    groups = totals.groupBy("node", group.alias("v")).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    beyond = suffix_sums(groups, bits - digit, digit).select("node", F.col("v").alias("group"), F.col("above").alias("more"), F.col("rows_above").alias("more_rows"))
    both = inside.join(beyond, ["node", "group"])
    return both.select("node", "v", (F.col("above") + F.col("more")).alias("above"), (F.col("rows_above") + F.col("more_rows")).alias("rows_above"))


def counted_above(pairs: DataFrame, digit: int = DIGIT) -> DataFrame:
    """``(slot, level, n_sales, n_rows)`` for ``pairs(slot, level, n, rows)``, each pair once: the sums
    of ``n`` and ``rows`` over all pairs of a smaller slot and a larger level."""
    slots, n_slots = dense_ranks(pairs, "slot")
    levels, n_levels = dense_ranks(pairs, "level")
    ranked = pairs.join(slots.withColumnRenamed("rank", "u"), "slot").join(levels.withColumnRenamed("rank", "v"), "level")
    ranked = cut(ranked.select("slot", "level", "u", "v", "n", "rows"))
    bits, found = max(1, (n_levels - 1).bit_length()), []
    for b in range(max(0, n_slots - 1).bit_length()):
        here = ranked.withColumn("node", F.shiftright("u", b + 1)).withColumn("right", F.col("u").bitwiseAND(F.lit(1 << b)) != 0)
        left = {x: F.sum(F.when(F.col("right"), 0).otherwise(F.col(x))).alias(x) for x in ("n", "rows")}
        merged = here.groupBy("node", "v").agg(*left.values())
        sums = suffix_sums(merged, bits, digit)
        found.append(here.where("right").join(sums, ["node", "v"]).select("slot", "level", "above", "rows_above"))
    zero = F.lit(0).cast("long")
    own = ranked.select("slot", "level", zero.alias("above"), zero.alias("rows_above"))
    every = reduce(DataFrame.unionByName, found, own)
    return every.groupBy("slot", "level").agg(F.sum("above").alias("n_sales"), F.sum("rows_above").alias("n_rows"))


def dominance_counts(rows: DataFrame, weight: str = "rows", digit: int = DIGIT) -> DataFrame:
    """``rows`` with ``n_sales``, the rows above each, and ``n_rows``, the sum of ``weight`` over them.

    ``rows`` has long ``slot`` and ``level``. Only frequent pairs' answers, 10,000 at most, are
    broadcast; the others meet their rows by key.
    """
    keep = [c for c in rows.columns if c not in ("n_sales", "n_rows")]
    rows = rows.select(*keep)
    placed = rows.where("slot is not null and level is not null")
    pairs = cut(placed.groupBy("slot", "level").agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("rows")))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    answers = counted_above(pairs, digit).join(pairs.select("slot", "level", "n"), ["slot", "level"])
    key = F.struct("slot", "level").alias("_pair")
    answers = cut(answers.select(key, "n_sales", "n_rows", F.col("n").alias("_n")))
    found = joined_by_count(placed.select(*keep, key), answers, "_pair", "_n", total).select(*keep, "n_sales", "n_rows")
    none = F.lit(None).cast("long")
    return found.unionByName(rows.where("slot is null or level is null").select(*keep, none.alias("n_sales"), none.alias("n_rows")))


def day_of(df: DataFrame, column: str) -> Column:
    """Days since 1970 of a time taken as UTC, whatever the session's zone."""
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.floor(F.unix_seconds(column) / 86400)
    return F.unix_date(F.col(column).cast("date")).cast("long")


def sale_rows(sales: DataFrame) -> DataFrame:
    """``(sale_id, slot, level, rows)``: day, price step and weight of each sale; a null id stands for one row."""
    cents = F.floor(F.lit(100.0) * F.col("total") + F.lit(0.5)).cast("double")
    finite = ~F.isnan("total") & (F.abs("total") < float("inf"))
    weight = 1 + F.pmod(F.coalesce(F.crc32(F.col("sale_id").cast("string")), F.lit(0)), F.lit(3))
    return sales.select(
        "sale_id", day_of(sales, "sold_at").alias("slot"), F.when(finite, F.floor(cents / F.lit(1000.0))).alias("level"), weight.cast("long").alias("rows")
    )


def op13_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_counts(sale_rows(table(spark, sf_dir, "sales"))).select("sale_id", "slot", "level", "n_sales", "n_rows")


QUERIES["op13_dominance"] = op13_dominance
ORACLES["op13_dominance"] = """
WITH crc AS (
  SELECT sale_id, sold_at, total,
    xor(list_reduce(list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b:
      list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) AS crc
  FROM sales
), rows AS (
  SELECT sale_id, floor(epoch(sold_at) / 86400)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 1000)::BIGINT AS level,
    1 + coalesce(crc, 0) % 3 AS weight
  FROM crc
), pairs AS MATERIALIZED (
  SELECT slot, level, count(*) AS n, sum(weight) AS w FROM rows WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level
), answers AS (
  SELECT b.slot, b.level, coalesce(sum(a.n), 0)::BIGINT AS n_sales, coalesce(sum(a.w), 0)::BIGINT AS n_rows
  FROM pairs b LEFT JOIN pairs a ON a.slot < b.slot AND a.level > b.level GROUP BY b.slot, b.level
)
SELECT r.sale_id, r.slot, r.level, n_sales, n_rows
FROM rows r LEFT JOIN answers x ON r.slot = x.slot AND r.level = x.level
"""
