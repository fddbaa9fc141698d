"""Ball-tree clustering against plain rounds, and balls against all distances."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from spanloom.llm import balls, catalog

SF = "/root/testdata/sf0.001"


def plain(vectors, start, rounds):
    z = start.copy()
    for _ in range(rounds):
        c = ((vectors[:, None] - z[None]) ** 2).sum(2).argmin(1)
        for k in range(len(z)):
            if (c == k).any():
                z[k] = vectors[c == k].sum(0) // (c == k).sum()
    d = ((vectors[:, None] - z[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1), z


@pytest.mark.parametrize("leaf, tree_rows", [(1, 50), (8, 33), (1000, 4096)])
def test_rounds_equal_plain_ones(spark, leaf, tree_rows):
    rng = np.random.default_rng(3)
    v = (rng.integers(0, 4, (300, 6)) + 40 * rng.integers(0, 3, (300, 1))).astype(np.int64)  # many ties and equal vectors
    v[200:260] = v[7]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<long>").repartition(3)
    order = sorted(range(300), key=lambda k: hashlib.sha256(f"2:{k}".encode()).hexdigest())[:7]
    cluster, distance, z = plain(v, v[order], 4)
    got = {r["vec_id"]: r for r in balls.ball_clusters(df, 7, 4, tree_rows=tree_rows, leaf=leaf).collect()}
    assert [got[k]["cluster"] for k in range(300)] == cluster.tolist()
    assert [got[k]["distance"] for k in range(300)] == distance.tolist()
    for k in range(300):
        c = cluster[k]
        assert got[k]["cluster_inertia"] == distance[cluster == c].sum() and got[k]["inertia"] == distance.sum()
        assert got[k]["centroid_sha256"] == hashlib.sha256(",".join(map(str, z[c].tolist())).encode()).hexdigest()


def test_whole_balls_are_assigned():
    """Far apart groups need no leaf: each is taken by its sum."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 9, (500, 4)), 10_000 + rng.integers(0, 9, (500, 4))]).astype(np.int64)
    order, nodes = balls.build(v, 16)
    tree = {k: np.array(x) for k, x in nodes.items()} | {"vectors": v[order]}
    got = list(balls.assign(tree, np.array([[0, 0, 0, 0], [10_000] * 4, [5_000] * 4])))
    assert sorted((int(b - a), c) for a, b, c, whole in got if whole is not None) == [(500, 0), (500, 1)] and len(got) == 2
    for k in range(len(tree["start"])):
        own = tree["vectors"][tree["start"][k] : tree["stop"][k]]
        assert (own.sum(0) == tree["sums"][k]).all()
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= tree["radius"][k] * (1 + 1e-9) + 1e-9


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    one = [0.5, -0.25]
    data = [(1, one), (1, one), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (6, [nan, 0.0]), (None, [3.0, 3.0]), (7, [0.0, 1.0, 2.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in data], "vec_id long, embedding array<float>, distance string, cluster int")
    got = balls.ball_clusters(balls.scaled(df, 2), 40).collect()
    assert sorted((r["vec_id"] is None, r["cluster"], r["distance"]) for r in got) == [(False, 0, 0), (False, 0, 0), (True, 2, 0)]
    assert balls.ball_clusters(balls.scaled(df.limit(0), 2)).count() == 0
    with pytest.raises(Exception, match="or more in size"):
        balls.ball_clusters(balls.scaled(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<float>"), 2)).collect()


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(SF)}/embeddings.parquet'")
    got = catalog.QUERIES["op12_ball_clusters"](spark, SF)
    want = duck.execute(catalog.ORACLES["op12_ball_clusters"])
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
