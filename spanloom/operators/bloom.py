"""Anti-joins against large sets of excluded keys, through a Bloom filter that is checked exactly.

Keys set bits where they lie: every partition ORs the words of its own filter (partial
aggregation), and the partitions' words are merged by one small exchange. Rows whose bits
are not all set cannot be excluded, and pass without a shuffle; the others are verified by a join.
The filter has ``most_bits`` bits at most, so what is broadcast does not grow with the keys. Beyond
that size more rows are verified, and the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.checkpoint import cut

PLACES = 6
#: bits for each key, of which one in fifty others then passes by chance at most
PER_KEY = 10


@dataclass(frozen=True)
class Bloom:
    bits: int
    words: Broadcast[np.ndarray]

    def may_hold(self, key: Column) -> Column:
        """False where the key is surely not among those the filter was built from; false for null."""
        words, bits = self.words, self.bits

        @F.arrow_udf("boolean")
        def all_set(hashes: pa.Array) -> pa.Array:
            return pa.array(bits_set(words.value, bits, hashes))

        return key.isNotNull() & all_set(F.xxhash64(key))

    def places(self, keys: Column) -> Column:
        """Places, from 0, of those keys of an array that the filter may hold; none for null."""
        words, bits = self.words, self.bits

        @F.arrow_udf("array<int>")
        def each(hashes: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            found = np.flatnonzero(bits_set(words.value, bits, pc.list_flatten(hashes)))
            cuts = np.r_[0, np.cumsum(np.bincount(row[found], minlength=len(sizes)))].astype(np.int32)
            at = found - (np.cumsum(sizes) - sizes)[row[found]]
            return pa.ListArray.from_arrays(pa.array(cuts), pa.array(at.astype(np.int32)))

        return each(F.transform(keys, lambda k: F.xxhash64(k)))


def bits_set(held: np.ndarray, bits: int, hashes: pa.Array) -> np.ndarray:
    """Whether all bits of each hash are set."""
    h = hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    found = np.ones(len(h), bool)
    for k in range(PLACES):
        place = (h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * (h >> np.uint64(32)) & np.uint64(bits - 1)
        found &= (held[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def bloom(keys: DataFrame, key: str, n: int, most_bits: int = 1 << 26) -> Bloom:
    """The filter of the ``n`` keys, whose size is a power of two; ``most_bits`` bounds what is collected and broadcast (8 MB)."""
    bits = 64
    while bits < min(n * PER_KEY, most_bits):
        bits *= 2
    h = F.col("h")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32)
    each = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    places = each.select(F.explode(F.array(*[(low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(PLACES)])).alias("place"))
    ored = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask"))
    got = ored.toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Bloom(bits, keys.sparkSession.sparkContext.broadcast(words))


def without(rows: DataFrame, excluded: DataFrame, key: str = "digest", most_bits: int = 1 << 26, least: int = 4096, most: int = 10_000) -> DataFrame:
    """``rows`` whose key is not among ``excluded``'s, as ``dedup.without`` has them; null keys stay.

    Suspicious rows are written once, so ``rows`` is read twice; ``verified`` settles them.
    """
    known = distinct_keys(excluded, key)
    suspected = bloom(known, key, known.count(), most_bits).may_hold(F.col(key))
    return rows.where(~suspected).unionByName(verified(cut(rows.where(suspected)), known, key, least, most))


def clean_counts(rows: DataFrame, keys: str, excluded: DataFrame, key: str, by: str = "doc_id", most_bits: int = 1 << 26, least: int = 4096, most: int = 10_000) -> DataFrame:
    """``(by, n_clean)``: how many keys of the arrays ``keys`` are not among ``excluded``'s; rows of one ``by`` are summed.

    The filter is asked inside the rows, which are read once; only keys that it may hold leave
    their array. Where nothing is clean (or the array is null), there is no row.
    """
    known = distinct_keys(excluded, key)
    held = bloom(known, key, known.count(), most_bits)
    probed = rows.select(by, keys).withColumn("at", held.places(F.col(keys)))
    probed = cut(probed.select(by, F.size(keys).alias("n"), F.transform("at", lambda k: F.get(F.col(keys), k)).alias("hits")))
    stay = verified(probed.select(by, F.explode("hits").alias(key)), known, key, least, most)
    every = probed.select(by, (F.col("n") - F.size("hits")).cast("long").alias("n")).unionByName(stay.select(by, F.lit(1).cast("long").alias("n")))
    return every.groupBy(by).agg(F.sum("n").alias("n_clean")).where("n_clean > 0")


def distinct_keys(excluded: DataFrame, key: str) -> DataFrame:
    return cut(excluded.select(key).where(F.col(key).isNotNull()).distinct())


def verified(suspects: DataFrame, known: DataFrame, key: str, least: int = 4096, most: int = 10_000) -> DataFrame:
    """``suspects`` whose key is not among the distinct ``known`` ones, whatever the filter said.

    Keys are counted, partially before the exchange; the fewer than ``most`` keys with over a
    ``most``-th of the rows are settled by a broadcast of their verdicts, so no frequent key's
    rows meet in one task. ``suspects`` is read three times and must be cut off.
    """
    counted = suspects.groupBy(key).agg(F.count("*").alias("_n"))
    counted = cut(counted.join(known.withColumn("_known", F.lit(True)), key, "left"))
    limit = max(least, (counted.agg(F.sum("_n")).first()[0] or 0) // most)
    verdict = max(suspects.columns, key=len) + "_hot"  # no column of ``suspects``
    hot = counted.where(F.col("_n") > limit).select(key, F.coalesce("_known", F.lit(False)).alias(verdict))
    marked = suspects.join(F.broadcast(hot), key, "left")  # fewer than ``most`` rows
    cold = counted.where((F.col("_n") <= limit) & F.col("_known")).select(key)
    rare = marked.where(F.col(verdict).isNull()).join(cold, key, "left_anti")
    return marked.where(~F.col(verdict)).unionByName(rare).select(*suspects.columns)
