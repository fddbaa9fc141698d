"""Dominance counts against all pairs, with outlying values, hot keys and odd rows."""

import random
import zlib

import duckdb
import pytest

from spanloom.llm import catalog, dominance

SF = "/root/testdata/sf0.001"


def all_pairs(rows):
    return [
        None if s is None or v is None else (sum(a < s and b > v for a, b, _ in fine(rows)), sum(w or 0 for a, b, w in fine(rows) if a < s and b > v)) for s, v, w in rows
    ]


def fine(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None]


@pytest.mark.parametrize("seed, digit", [(0, 6), (1, 1), (2, 2)])
def test_counts_equal_all_pairs(spark, seed, digit):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 10**9, *range(-3, 9)]), rng.choice([None, -(10**12), 10**15, *range(12)]), rng.choice([1, 2, 3, None])) for _ in range(400)]
    rows += [(2, 5, 1)] * 300  # a pair with many rows
    df = spark.createDataFrame([(k, *r, "x", 0) for k, r in enumerate(rows)], "k long, slot long, level long, rows long, node string, n long")
    got = {r["k"]: None if r["n_sales"] is None else (r["n_sales"], r["n_rows"]) for r in dominance.dominance_counts(df, digit=digit).collect()}
    assert [got[k] for k in range(len(rows))] == all_pairs(rows)


def test_one_slot_one_level_and_none(spark):
    schema = "slot long, level long, rows long"
    counts = lambda rows: sorted(map(tuple, dominance.dominance_counts(spark.createDataFrame(rows, schema)).select("n_sales", "n_rows").collect()))
    assert counts([(1, 5, 1), (1, 6, 1)]) == [(0, 0), (0, 0)]
    assert counts([(1, 5, 1), (2, 5, 1)]) == [(0, 0), (0, 0)]
    assert counts([(1, 6, 3), (2, 5, 1)]) == [(0, 0), (1, 3)]
    assert counts([(None, 6, 3)]) == [(None, None)]
    assert counts([]) == []


def test_ranks_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(x,) for x in [5, 5, None, -7, 10**14, 3, 5]], "v long").repartition(5)
    ranks, n = dominance.dense_ranks(df, "v")
    assert n == 4 and sorted(map(tuple, ranks.collect())) == [(-7, 0), (3, 1), (5, 2), (10**14, 3)]


def test_sale_rows(spark):
    rows = [(1, 9.996, "1970-01-02 23:59:59.9"), (2, 10.0, "1969-12-31 23:59:59.5"), (None, float("nan"), None), (3, float("inf"), "2024-01-01 00:00:00"), (10**12, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "sale_id long, total double, t string").selectExpr("*", "cast(t as timestamp_ntz) as sold_at")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [tuple(r) for r in dominance.sale_rows(df).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        weight = lambda k: 1 + zlib.crc32(str(k).encode()) % 3
        assert got == [(1, 1, 1, weight(1)), (2, -1, 1, weight(2)), (None, None, None, 1), (3, 19723, None, weight(3)), (10**12, 19723, None, weight(10**12))]


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW sales AS SELECT * FROM '{SF}/sales.parquet'")
    got = catalog.QUERIES["op13_dominance"](spark, SF)
    want = duck.execute(catalog.ORACLES["op13_dominance"])
    names = [x[0] for x in want.description]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
