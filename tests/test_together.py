"""Rows that lie together by document against the forms that deal them out, and plans without exchanges of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import ensemble, metrics, sequence, spans, tables
from spanloom.plans import annotation, catalog, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture()
def carried(spark):
    rng = random.Random(3)
    rows = []
    for d in [*range(40), None, 41]:
        at = 0
        for k in range(rng.randint(1, 30)):
            size = rng.randint(0, 6)
            span = (rng.choice(spans.LABELS), at, at + rng.randint(1, 15)) if rng.random() < 0.4 else (None, None, None)
            rows.append((d, k, at, at + size, rng.choice(sequence.CATEGORIES), *span))
            at += size + rng.randint(0, 1)
    return spark.createDataFrame(rows, "doc_id long, pos int, start long, end long, category string, label string, span_start long, span_end long").coalesce(1)


@pytest.mark.parametrize("size", ["7", "10000"])
def test_align_and_what_follows_equal_the_dealt_forms(spark, carried, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    marks = carried.where("label is not null").select("doc_id", "label", F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    want = spans.align(carried.drop("label"), marks)
    got = spans.align_together(carried)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    for scheme in ("bio", "bilou"):
        tagged = spans.encode(got, scheme)
        assert sorted(map(repr, spans.decode_together(carried, scheme).collect())) == sorted(map(repr, spans.decode(tagged).collect()))
    # tokens of no width share their start with the next token, which leaves their order open
    wide = carried.where("start < end")
    counts = sequence.transition_counts(spans.encode(spans.align_together(wide), "bilou")).select("category", "prev", "cur", "n")
    assert sorted(map(repr, sequence.transition_counts_together(wide, "bilou").collect())) == sorted(map(repr, counts.collect()))
    assert sequence.transition_counts_together(carried.limit(0), "bilou").count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grid_equals_the_dealt_form(spark):
    rng = random.Random(4)
    rows = [(d, k * 4, k * 4 + 3, k * 4 + rng.randint(-3, 3), k * 4 + rng.randint(4, 9), [rng.random(), rng.random()]) for d in range(5) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, s long, e long, ps array<double>").coalesce(1)
    flat = df.select("doc_id", F.col("s").alias("start"), F.col("e").alias("end"), F.posexplode("ps").alias("tag", "p")).withColumn("tag", F.col("tag").cast("string"))
    want = {(r["doc_id"], r["start"], r["tag"]): (r["total"], r["weight"]) for r in ensemble.onto_grid(df, flat).collect()}
    got = {(r["doc_id"], r["start"], str(k)): (r["totals"][k], r["weight"]) for r in ensemble.onto_grid_together(df).collect() for k in range(2) if r["weight"]}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("name, most", [("token_entity_align", 0), ("bilou_decode", 0), ("bio_decode", 0), ("viterbi_decode", 0), ("grid_overlap_blend", 0), ("transition_counts", 1), ("token_category", 1)])
def test_tokens_are_not_shuffled(spark, name, most):
    assert exchanges(registry.QUERIES[name](spark, SF)) <= most


def test_weight_search_stores_nothing(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows, _ = annotation.grid_parts(spark, SF)
    registry.QUERIES["blend_weight_search"](spark, SF)
    assert exchanges(rows) == 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_slices_and_errors_equal_the_joined_forms(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, None, 0, 1, 4]), d, rng.choice([*spans.LABELS, "MISC"]), s, s + rng.randint(0, 4), d % 3, 20) for d in range(30) for s in [rng.randint(0, 19) for _ in range(12)]]
    rows += [(2, 50, "ORG", 1, 2, 7, 20), (None, 51, "ORG", 1, 2, 8, 20)]
    df = spark.createDataFrame(rows, "run int, doc_id long, label string, start long, end long, bucket int, n long").coalesce(1)
    gold, predicted = df.where("run is null").drop("run", "bucket", "n"), df.where("run is not null").drop("bucket", "n")
    docs = df.select("doc_id", "bucket", "n").distinct()
    want = metrics.slices(gold, predicted, docs, F.col("bucket"))
    assert sorted(map(repr, metrics.slices_together(df).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    errors = spans.span_errors(df.drop("run", "bucket", "n"), docs.select("doc_id", "n"))
    assert sorted(map(repr, spans.span_errors_together(df).collect())) == sorted(map(repr, errors.collect()))
    assert metrics.slices_together(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["span_prf_by_lang", "span_prf_by_length", "slice_delta", "entity_validation"])
def test_spans_are_not_joined(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(doc_id" not in plan


def test_a_row_of_the_window_function_may_stand_for_many_tokens(spark):
    tables.register(spark)
    one = spark.createDataFrame([(1, 300), (2, 1), (3, 126)], "doc_id long, n_tokens long")
    each = one.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_tokens").cast("int")))).select("doc_id")
    got = [spark.sql("SELECT * FROM token_windows(TABLE({t}) PARTITION BY (doc_id), 128, 30)", t=t).collect() for t in (one, each)]
    assert sorted(got[0]) == sorted(got[1])
