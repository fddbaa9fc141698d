"""Exact top-k against plain sums: repeated rows and ids, huge components, sparse rows, cells of any size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import topk


def brute(rows, k, every=20):
    """``{query id: sorted (score, vec_id) lists}`` in Python's whole numbers."""
    low, high = -(1 << 63), (1 << 63) - 1
    clip = lambda x: min(max(x, low), high)
    fine = [(i, [clip(math.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in fine:
        if q % every == 0:
            out.setdefault(q, []).extend((sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)
    return {q: [(clip(s), i) for s, i in sorted(x, key=lambda z: (-z[0], z[1]))[:k]] for q, x in out.items()}


def run(spark, rows, k, *sizes):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, score int")
    got = {}
    for r in sorted(topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 20 == 0, k, *sizes).collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = got.setdefault(r["query_id"], [])
        own.append((r["score"], r["vec_id"]))
        assert r["rank"] == len(own)
    return got


@pytest.mark.parametrize("sizes", [(16_384, 16_384), (3, 16)])
def test_top_k_equals_plain_sums(spark, sizes):
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.0, 0.0, rng.uniform(-2, 2)]) for _ in range(rng.choice([0, 3, 8, 8, 8]))]) for k in range(130)]
    rows += [(k, rows[k][1]) for k in range(1, 130, 7)] + [(20, rows[5][1]), (None, [1.0]), (131, None), (132, [None, 1.0]), (133, [float("nan")]), (140, [float("inf")])]
    assert run(spark, rows, 20, *sizes) == brute(rows, 20)


def test_repeated_query_rows_are_one_query(spark):
    rows = [(0, [1.0]), (0, [3.0]), (1, [2.0]), (2, [1.0]), (2, [1.0])]
    assert run(spark, rows, 3) == {0: [(64 * 64 * 6, 1), (64 * 64 * 3, 2), (64 * 64 * 3, 2)]} == brute(rows, 3)


def test_scores_beyond_a_long(spark):
    rows = [(0, [3e38, 1.0]), (1, [1.0, 0.0]), (2, [3e38, 3e38]), (3, [-3e38, 0.0]), (4, [1e15, 1.0]), (5, [0.0, 2.0]), (6, [2.0**55, 0.0])]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_narrow_types():
    import numpy as np

    assert topk.exact_type(np.array([128]), np.array([-128]), 64) is np.int32
    assert topk.exact_type(np.array([1 << 20]), np.array([1 << 20]), 64) is np.int64
    assert topk.exact_type(np.array([1 << 40]), np.array([1 << 40]), 1) is object
    assert topk.exact_type(np.zeros(0, int), np.zeros(0, int), 0) is np.int32


def test_frequent_ids_are_dealt_out(spark):
    """Four fifths of the rows have one id, and equal rows of a query are searched once."""
    rows = [(7, [float(k % 5), 1.0]) for k in range(800)] + [(k, [1.0, float(k % 3)]) for k in range(100, 200)] + [(20, [1.0, 2.0])] * 300
    assert run(spark, rows, 20, 64, 128) == brute(rows, 20)
    df = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(4))
    sizes = [r["count"] for r in df.groupBy(block.alias("b")).count().collect()]
    assert max(sizes) < 1.3 * min(sizes)
