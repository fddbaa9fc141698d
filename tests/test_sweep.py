"""Sweeps against all pairs of a document, signatures in the row, table functions against the column forms, ranges with outliers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import dedup, ensemble, passages, running, sequence, spans, tables


def some(rng, n, docs, most=60, labels=("ORG", "NAME", "GEO")):
    rows = []
    for _ in range(n):
        s = rng.randint(0, most)
        rows.append((rng.choice(docs), rng.choice(labels), s, s + rng.randint(1, 12)))
    return rows


@pytest.mark.parametrize("parts", [1, 3])
def test_align_equals_all_pairs(spark, parts):
    rng = random.Random(parts)
    docs = [None, *range(12)]
    tokens = [(d, k, s, s + rng.choice([0, 1, 3, 7])) for d in docs for k, s in enumerate(sorted(rng.randint(0, 60) for _ in range(25)))]
    marks = some(rng, 90, docs) + [(3, "ORG", 0, 70), (3, "GEO", 0, 70), (99, "ORG", 0, 5)]
    t = spark.createDataFrame(tokens, "doc_id long, pos long, start long, end long").repartition(parts)
    got = {(r["doc_id"], r["pos"]): (r["label"], r["span_start"], r["span_end"], r["special"]) for r in spans.align(t, spark.createDataFrame(marks, "doc_id long, label string, start long, end long")).collect()}
    for d, k, s, e in tokens:
        hits = sorted((a, b, x) for o, x, a, b in marks if d is not None and o == d and b > s and a < e and s < e)
        assert got[d, k] == ((hits[0][2], hits[0][0], hits[0][1]) if hits else (None, None, None)) + (s == e,)
    assert spans.align(t.limit(0), spark.createDataFrame(marks, "doc_id long, label string, start long, end long")).count() == 0
    assert spans.align(t, spark.createDataFrame([], "doc_id long, label string, start long, end long")).where("label is not null").count() == 0


def test_grid_equals_all_pairs(spark):
    rng = random.Random(5)
    docs = [1, 2, 3, None]
    grid = sorted({(d, s, s + w) for d, _, s, w in some(rng, 60, docs) for w in [rng.randint(1, 9)]}, key=str)
    probs = [(d, s, e, x, rng.random()) for d, x, s, e in some(rng, 150, docs)]
    got = {(r["doc_id"], r["start"], r["end"], r["tag"]): (r["total"], r["weight"]) for r in ensemble.onto_grid(
        spark.createDataFrame(grid, "doc_id long, start long, end long"), spark.createDataFrame(probs, "doc_id long, start long, end long, tag string, p double")).collect()}
    want = {}
    for d, a, b in grid:
        for o, s, e, x, p in probs:
            if d is not None and o == d and s < b and e > a:
                w = min(e, b) - max(s, a)
                old = want.get((d, a, b, x), (0, 0))
                want[d, a, b, x] = old[0] + p * w, old[1] + w
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_long_document_takes_linear_time(spark):
    n = 100_000
    tokens = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + 5).alias("end"))
    marks = spark.range(n // 2).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ORG").alias("label"), (F.col("id") * 12).alias("start"), (F.col("id") * 12 + 5).alias("end"))
    began = time.perf_counter()
    assert spans.align(tokens, marks).where("label is not null").count() == n // 2
    assert time.perf_counter() - began < 60


def test_signature_in_the_row_equals_exploded_shingles(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb", "ü", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["", "one", "nb sp  ace a b c d", None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, t string").withColumn("t", T.normalize(F.col("t")))
    each = df.where("t is not null").select("seq", F.explode(dedup.shingles(F.col("t"))).alias("s")).select("seq", F.conv(F.substring(F.md5("s"), 1, 15), 16, 10).cast("long").alias("h"))
    mins = [F.min(F.col("h").bitwiseXOR(F.lit(m).cast("long"))).alias(f"m{k}") for k, m in enumerate(dedup.masks())]
    want = {r["seq"]: list(r)[1:] for r in each.groupBy("seq").agg(*mins).collect()}
    assert {r["seq"]: r["signature"] for r in dedup.minhash(df, F.col("t")).collect()} == want


def test_table_functions_equal_columns(spark):
    tables.register(spark)
    rng = random.Random(7)
    tokens = spark.createDataFrame([(d, k) for d in range(9) for k in range(rng.randint(1, 700))], "doc_id long, pos long")
    got = spark.sql("SELECT * FROM token_windows(TABLE({t}) PARTITION BY (doc_id), 130, 40)", t=tokens)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sequence.windows(tokens, 130, 40).collect()))
    docs = spark.createDataFrame([(k, "\n\n".join("word " * rng.randint(1, 40) for _ in range(8))) for k in range(20)] + [(99, None)], "doc_id long, text string")
    got = spark.sql("SELECT * FROM passages(TABLE({d}), 120)", d=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, passages.split_passages(docs, 120).collect()))
    sizes = spark.createDataFrame([(k, k % 3, rng.choice([0, 5, 300, 1300])) for k in range(60)], "seq long, shard int, n_tokens long")
    got = spark.sql("SELECT * FROM packed(TABLE({s}) PARTITION BY (shard) ORDER BY (seq), 510)", s=sizes)
    want = [tuple(r) for k in range(3) for r in sequence.blocks(sizes.where(F.col("shard") == k), 510).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ranges_have_equal_sizes_in_spite_of_outliers(spark):
    df = spark.createDataFrame([(k,) for k in range(4000)] + [(10**15,), (-(10**15),)], "seq long")
    sizes = [r["count"] for r in running.in_ranges(df, "seq", 500).groupBy("range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000


def test_sequences_side_by_side_equal_one_by_one():
    import numpy as np

    rng = np.random.default_rng(3)
    size = np.r_[rng.integers(0, 30, 60), 0, 200, 1]
    cuts = np.r_[0, np.cumsum(size)]
    p, category = rng.integers(1, 4, (cuts[-1], 5)) / 4, rng.integers(0, 3, cuts[-1])  # few values: many ties
    log_t = np.log(rng.integers(1, 4, (3, 5, 5)) / 4)
    want = [k for s, e in zip(cuts[:-1], cuts[1:]) for k in sequence.viterbi_path(p[s:e], category[s:e], log_t)]
    assert sequence.viterbi_paths(p, category, cuts, log_t).tolist() == want
    assert len(sequence.viterbi_paths(np.zeros((0, 5)), np.zeros(0, int), np.zeros(1, int), log_t)) == 0
