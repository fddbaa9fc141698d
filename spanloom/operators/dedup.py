"""Exact, paragraph and near-duplicate removal in stream order.

``seq`` is the stream order, and names a row. A key's first row comes from partial minima,
and whether a row is a first one from a join on ``seq``, so the rows of a frequent key never
meet in one task. The greedy near rule runs in rounds cut off in the checkpoint folder.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.checkpoint import cut
from spanloom.functions.text import digest, normalize
from spanloom.operators.joins import firsts, joined_by_count

BANDS, ROWS = 8, 4
# fixed value: odd constant that spreads the permutation masks
SPREAD = 0x9E3779B97F4A7C15
HASH_BITS = 60
#: white space as ``shingles`` has it
WHITE = " \t\n\v\f\r\u00a0"
SPACES = re.compile(f"[{WHITE}]+")


def exact_duplicates(rows: DataFrame, key: str = "digest", order: str = "seq") -> DataFrame:
    """``is_dup``: whether an earlier row has the key."""
    first = firsts(rows, key, order=order).withColumn("is_first", F.lit(True))
    return rows.join(first, order, "left").withColumn("is_dup", F.col("is_first").isNull()).drop("is_first")


def without(rows: DataFrame, excluded: DataFrame, key: str = "digest") -> DataFrame:
    """Rows whose key is not among the excluded ones."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def paragraph_duplicates(paragraphs: DataFrame, order: str = "seq", min_chars: int = 80) -> DataFrame:
    """``(seq, n_long, paragraph_dup)``: a passage is one if it has paragraphs longer than
    ``min_chars`` and an earlier passage has each of them."""
    p = paragraphs.withColumn("paragraph", F.regexp_replace("paragraph", r"^[\s\x{00A0}]+|[\s\x{00A0}]+\z", ""))
    long = p.where(F.length("paragraph") > min_chars).withColumn("key", digest(normalize(F.col("paragraph"))))
    fresh = firsts(long, "key", order=order).withColumn("fresh", F.lit(True))  # passages that bring a paragraph
    every = p.groupBy(order).agg(F.count_if(F.length("paragraph") > min_chars).alias("n_long"))
    return every.join(fresh, order, "left").select(order, "n_long", ((F.col("n_long") > 0) & F.col("fresh").isNull()).alias("paragraph_dup"))


def shingles(normalized: Column, width: int = 5) -> Column:
    """Distinct word windows of a normalised text; one of all its words where it has fewer."""
    w = F.regexp_extract_all(normalized, F.lit(r"[^\s\x{00A0}]+"), F.lit(0))

    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - width, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i + 1, width), " ")))

    # a variable of an outer lambda holds the words, which would else be split again for every window
    return F.element_at(F.transform(F.array(w), windows), 1)


def masks(n: int = BANDS * ROWS) -> list[int]:
    return [k * SPREAD & ((1 << HASH_BITS) - 1) for k in range(n)]


def minhash(rows: DataFrame, text: Column, order: str = "seq", n: int = BANDS * ROWS, width: int = 5) -> DataFrame:
    """``(seq, signature)``: the least hash of the row's shingles under each mask, found in the row, without a shuffle.

    A hash has the first 60 bits of a shingle's MD5. Null texts have no signature and no row.
    """

    @F.arrow_udf("array<bigint>")
    def least(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _signature(t, n, width).tolist() for t in texts.to_pylist()], pa.list_(pa.int64()))

    return rows.where(text.isNotNull()).select(order, least(text).alias("signature"))


def _signature(normalized: str, n: int, width: int) -> np.ndarray:
    words = SPACES.split(normalized.strip(WHITE))
    shingled = {" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))}
    raw = np.frombuffer(b"".join(hashlib.md5(x.encode(), usedforsecurity=False).digest()[:8] for x in shingled), ">u8")
    hashes = (raw >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    marks, low = np.array(masks(n), np.int64), np.full(n, np.iinfo(np.int64).max)
    for k in range(0, len(hashes), 4096):  # bounded memory for very long texts
        np.minimum(low, (hashes[None, k : k + 4096] ^ marks[:, None]).min(1), out=low)
    return low


def band_keys(signatures: DataFrame, order: str = "seq", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(seq, band, key)``, one row for each band."""
    keys = [F.md5(F.array_join(F.slice(F.col("signature"), b * rows + 1, rows).cast("array<string>"), ",")) for b in range(bands)]
    return signatures.select(order, F.posexplode(F.array(*keys)).alias("band", "key"))


def signature_classes(signatures: DataFrame, order: str = "seq") -> DataFrame:
    """``(seq, rep)``: each row with the first row of its signature."""
    known = cut(signatures.select(order, F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("print")))
    first = known.groupBy("print").agg(F.min(order).alias("rep"), F.count("*").alias("n"))
    return joined_by_count(known, first, "print", "n", known.count()).select(order, "rep")


def candidate_pairs(signatures: DataFrame, order: str = "seq") -> DataFrame:
    """``(a, b)``, a < b: rows of different signatures that share a bucket; copies are folded into their class's first row.

    Buckets of one representative have no pairs and drop out before the join.
    """
    known = signatures.select(order, "signature", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("print"))
    first = known.groupBy("print").agg(F.min_by("signature", order).alias("signature"), F.min(order).alias(order))
    keys = cut(band_keys(first.select(order, "signature"), order))
    many = keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    own = keys.join(many, ["band", "key"])
    left, right = own.select("band", "key", F.col(order).alias("a")), own.select("band", "key", F.col(order).alias("b"))
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def bucket_links(keys: DataFrame, order: str = "seq") -> DataFrame:
    """``(a, b)``: each row b with the first row a of each of its buckets, instead of all pairs of a bucket.

    Rows that share buckets are connected by these links just as by all pairs; buckets of
    equal rows and near ones alike give one link a row, and a bucket is its own membership.
    Keys are made once, cut off, and read for each join: they are short, what they are made of is not.
    """
    keys = cut(keys)
    size = keys.groupBy("band", "key").agg(F.min(order).alias("a"), F.count("*").alias("n")).where("n > 1")
    named = size.select(F.struct("band", "key").alias("bucket"), "a", "n")
    rows = keys.select(order, F.struct("band", "key").alias("bucket"))
    found = joined_by_count(rows, named, "bucket", "n", keys.count())
    return found.select("a", F.col(order).alias("b")).where("a < b").distinct()


def _all_first(keys: DataFrame, order: str) -> DataFrame:
    """``(seq, all_first)``: whether the row is the first one in each of its buckets."""
    won = keys.groupBy("band", "key").agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("won"))
    each = keys.groupBy(order).agg(F.countDistinct("band", "key").alias("n"))
    return each.join(won, order, "left").select(order, (F.coalesce("won", F.lit(0)) == F.col("n")).alias("all_first"))


def first_in_bucket(keys: DataFrame, order: str = "seq") -> DataFrame:
    """``(seq, near_dup)``: whether any of a row's keys is an earlier row's (one pass, stricter than the greedy rule)."""
    return _all_first(cut(keys), order).select(order, (~F.col("all_first")).alias("near_dup"))


def greedy_near_duplicates(keys: DataFrame, order: str = "seq") -> DataFrame:
    """``(seq, near_dup)``: a row is one if it shares a key with an earlier *accepted* row.

    Rounds: undecided rows that are first among the undecided of all their
    buckets are accepted; undecided rows behind an accepted one in a bucket are rejected.
    Rejected rows shield nobody. Each round settles at least the first undecided row.
    """
    state = cut(keys.select(order, F.struct("band", "key").alias("bucket"), F.lit(None).cast("boolean").alias("near_dup")))
    total = state.count()
    done: list[DataFrame] = []
    left = total
    while left:
        first = state.groupBy("bucket").agg(F.min(order).alias(order), F.count("*").alias("n"))
        won = first.groupBy(order).agg(F.count("*").alias("won"))
        each = state.groupBy(order).agg(F.countDistinct("bucket").alias("n"))
        accepted = each.join(won, order).where("won = n").select(order)
        # an accepted row is the first of its buckets, so a bucket's winner is its first row if that is accepted
        winner = first.where("n > 1").withColumnRenamed(order, "winner").join(accepted.withColumnRenamed(order, "winner"), "winner", "left_semi")
        hit = joined_by_count(state.select(order, "bucket"), winner, "bucket", "n", total).where(F.col(order) > F.col("winner")).select(order).distinct()
        settled = cut(accepted.withColumn("near_dup", F.lit(False)).unionByName(hit.withColumn("near_dup", F.lit(True))))
        done.append(settled)
        state = cut(state.join(settled.select(order), order, "left_anti"))
        left = state.count()
    out = keys.select(order, F.lit(False).alias("near_dup")).limit(0)
    for settled in done:
        out = out.unionByName(settled)
    return out
