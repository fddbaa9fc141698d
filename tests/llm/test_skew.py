"""Frequent keys: joins that deal them out, contraction by rounds, many equal rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import graph, neardup, simhash
from spanloom.llm.common import joined_by_count
from spanloom.llm.graph import local_components


def test_join_of_frequent_keys(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("key"), "id")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = joined_by_count(rows, counted, "key", "n", 6000, least=100)
    assert got.columns == ["key", "id", "n"]
    assert {(r["id"], r["n"]) for r in got.collect()} == {(k, 1 if k % 3 else 2000) for k in range(6000)}


@pytest.mark.parametrize("in_task", [0, 1_000_000])
def test_components_by_rounds_and_in_a_task(spark, in_task):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(1000, k) for k in range(1001, 7001)] + [(k, k + 1) for k in range(8000, 8012)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), in_task=in_task).collect()}
    import numpy as np

    root = local_components(8041, *np.array(edges).T)
    assert got == {k: int(root[k]) for e in edges if e[0] != e[1] for k in e}


def test_many_equal_rows(spark):
    docs = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 20_000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "one and the same text of some words").otherwise(F.concat(F.lit("other "), F.md5(F.col("id").cast("string")))).alias("text")
    )
    docs = docs.unionByName(spark.createDataFrame([(None, "one and the same text of some words"), (None, None), (7, "")], "doc_id long, text string"))
    got = simhash.near_duplicates(docs)
    same = got.where("fp = (SELECT 0)").count()
    assert same == 2 and got.count() == 60_003
    prints = {r["fp"]: r for r in got.groupBy("fp").agg(F.count("*").alias("n"), F.countDistinct("component_id").alias("k")).where("n > 2").collect()}
    assert [(r["n"], r["k"]) for r in prints.values()] == [(20_001, 1)]


def test_near_dedup_with_and_without_plain_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    near = [" ".join([*t.split()[:30], "changed", *t.split()[31:]]) for t in texts[:20]]
    rows = [(k, t, "x", 1) for k, t in enumerate(texts + near + texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chosen_id string, fp int")
    again = docs.unionByName(docs)
    assert neardup.plain_ids(neardup.signatures(docs)) and not neardup.plain_ids(neardup.signatures(again))
    for frame in (docs, again):
        kept = neardup.keep_first(frame)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_simhash_proposes_near_duplicates(spark):
    texts = [" ".join(f"v{k}x{j}" for j in range(900)) for k in range(12)]
    near = [t.replace(f"v{k}x899", "last") for k, t in enumerate(texts[:8])]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts + near + [texts[0].upper(), ""])], "doc_id long, text string, chosen_id string, fp int")
    own = neardup.signatures(docs)
    assert {(r["doc_id"], r["sim"]) for r in own.collect()} == {(r["doc_id"], r["fp"]) for r in simhash.fingerprints(docs).collect()}
    pairs = {r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id between 12 and 19").collect()}
    want = sum(k < 12 for k in pairs)
    assert want and neardup.simhash_links(own).count() == want
    bare = neardup.folded(own.withColumn("keys", F.array().cast("array<long>")))  # no bands: only SimHash proposes
    found = neardup.links(docs, bare, True, proposed=neardup.simhash_links(own)).count()
    assert found == want and neardup.keep_first(docs).count() == 13
