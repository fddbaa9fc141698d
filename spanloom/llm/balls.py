"""Centroid clustering with ball-tree filtering.

Vectors of whole numbers are put into metric trees once, inside the partitions they are read
in. A node holds a stretch of the tree's vectors with their count, integer sum, centre and
radius. In each round the trees meet the centroids: a centroid that is farther from a ball
than another can be, by the triangle inequality, is filtered out; a ball with one centroid
left is assigned whole, by its count and sum, and other balls are descended, down to leaves
whose vectors are compared exactly. Each tree gives at most one row of sums for a centroid, so what
is shuffled, and what reaches the driver, is bounded by the numbers of centroids and trees.

Balls are compared in floating point with a margin above its rounding error; vectors are
compared in whole numbers. So assignments are exact, with ties to the smaller number.

Defined results: null vectors, vectors of another length and those with null or non-finite
components take no part; fewer vectors than ``k`` give fewer centroids; a null id hashes
after all others; equal vectors are neighbours in the seeds' order by hash; repeated rows
count each time; an empty table gives no rows; further columns are not read. Components of
2 ** 27 and more in size are an error, since their squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import cut, release, table
from spanloom.llm.registry import ORACLES, QUERIES

TREE = "ids array<long>, vectors binary, start array<int>, stop array<int>, child array<int>, sums binary, radius array<double>"
LIMIT = 1 << 27


def build(vectors: np.ndarray, leaf: int) -> tuple[np.ndarray, dict]:
    """Order of the vectors in the tree, and its nodes: stretch, first child (0: a leaf; the other follows it), sum, radius.

    A ball is halved at the median of its vectors' places between two far ends.
    """
    order = np.arange(len(vectors))
    start, stop, child = [0], [len(vectors)], []
    sums, radius = [], []
    k = 0
    while k < len(start):
        a, b = start[k], stop[k]
        own = vectors[order[a:b]]
        total = own.sum(0)
        far = np.sqrt(((own - total / (b - a)) ** 2).sum(1))
        sums.append(total)
        radius.append(float(far.max()))
        if b - a <= leaf or radius[-1] == 0:
            child.append(0)
        else:
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            place = np.argsort(own @ (other - one), kind="stable")
            order[a:b] = order[a:b][place]
            middle = (a + b) // 2
            child.append(len(start))
            start += [a, middle]
            stop += [middle, b]
        k += 1
    return order, {"start": start, "stop": stop, "child": child, "sums": np.array(sums, np.int64), "radius": radius}


def trees(rows: DataFrame, dim: int, tree_rows: int, leaf: int) -> DataFrame:
    """One row for each tree of at most ``tree_rows`` vectors of ``rows(vec_id, v)``, without a shuffle."""

    def grown(ids: list, vectors: np.ndarray) -> pa.RecordBatch:
        order, nodes = build(vectors, leaf)
        body = {"ids": [[ids[i] for i in order]], "vectors": [vectors[order].astype("<i4").tobytes()], "start": [nodes["start"]], "stop": [nodes["stop"]]}
        body |= {"child": [nodes["child"]], "sums": [nodes["sums"].astype("<i8").tobytes()], "radius": [nodes["radius"]]}
        kinds = {"ids": pa.list_(pa.int64()), "vectors": pa.binary(), "start": pa.list_(pa.int32()), "stop": pa.list_(pa.int32()), "child": pa.list_(pa.int32()), "sums": pa.binary(), "radius": pa.list_(pa.float64())}
        return pa.RecordBatch.from_pydict({c: pa.array(body[c], kind) for c, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and max(abs(int(flat.min())), abs(int(flat.max()))) >= LIMIT:
                raise ValueError(f"a scaled component is {LIMIT} or more in size")
            ids += batch.column("vec_id").to_pylist()
            held.append(flat.reshape(-1, dim))
            if len(ids) >= tree_rows:
                both = np.concatenate(held)
                for k in range(0, len(ids) - tree_rows + 1, tree_rows):
                    yield grown(ids[k : k + tree_rows], both[k : k + tree_rows])
                rest = len(ids) // tree_rows * tree_rows
                ids, held = ids[rest:], [both[rest:]]
            release()
        if ids:
            yield grown(ids, np.concatenate(held))

    return rows.select("vec_id", "v").mapInArrow(run, TREE)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row for each vector."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = vectors - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def assign(tree: dict, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
    """``(start, stop, cluster, sum)`` of balls assigned whole, and ``(start, stop, clusters, None)`` of leaves."""
    start, stop, child, sums, radius, vectors = (tree[x] for x in ("start", "stop", "child", "sums", "radius", "vectors"))
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        node, left = todo.pop()
        a, b = start[node], stop[node]
        off = sums[node] / (b - a) - centroids[left]
        near = np.sqrt((off * off).sum(1))
        reach = near.min() + 2 * radius[node]
        left = left[near <= reach + 1e-9 * (1 + reach)]
        if len(left) == 1:
            yield a, b, int(left[0]), sums[node]
        elif child[node]:
            todo += [(child[node], left), (child[node] + 1, left)]
        else:
            yield a, b, left[squared(vectors[a:b], centroids[left]).argmin(1)], None


def read(batch: pa.RecordBatch, row: int, dim: int) -> dict:
    """One tree of a batch in numpy."""
    tree = {c: batch.column(c)[row].values.to_numpy() for c in ("start", "stop", "child", "radius")}
    tree["sums"] = np.frombuffer(batch.column("sums")[row].as_buffer(), "<i8").reshape(-1, dim)
    tree["vectors"] = np.frombuffer(batch.column("vectors")[row].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
    tree["ids"] = batch.column("ids")[row].values
    return tree


def partial_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """For each batch of trees, count and componentwise sum of each centroid's vectors."""
    for batch in batches:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64)
        for row in range(batch.num_rows):
            tree = read(batch, row, dim)
            for a, b, cluster, whole in assign(tree, centroids):
                if whole is not None:
                    count[cluster] += b - a
                    total[cluster] += whole
                else:
                    np.add.at(count, cluster, 1)
                    np.add.at(total, cluster, tree["vectors"][a:b])
        some = np.flatnonzero(count)
        offsets = pa.array(np.arange(len(some) + 1) * dim, pa.int32())
        yield pa.RecordBatch.from_pydict({"cluster": some, "n": count[some], "total": pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel()))})


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """``(vec_id, cluster, distance)`` of every vector."""
    for batch in batches:
        for row in range(batch.num_rows):
            tree = read(batch, row, dim)
            cluster = np.empty(len(tree["vectors"]), np.int32)
            for a, b, own, _ in assign(tree, centroids):
                cluster[a:b] = own
            off = tree["vectors"] - centroids[cluster]
            yield pa.RecordBatch.from_pydict({"vec_id": tree["ids"], "cluster": cluster, "distance": np.einsum("ij,ij->i", off, off)})
        release()


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in the order of the hashes."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(place.alias("place"), "v").orderBy(F.asc_nulls_last("place"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def ball_clusters(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, tree_rows: int = 4096, leaf: int = 16) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of ``rows(vec_id, v)``.

    All ``v`` have one length. ``k`` rows of one vector each are all that the driver holds.
    """
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    dim = centroids.shape[1]
    held = cut(trees(rows, dim, tree_rows, leaf))
    for _ in range(rounds):
        now = centroids
        parts = held.mapInArrow(lambda batches, now=now: partial_sums(batches, now, dim), "cluster long, n long, total array<long>")
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(dim)])
        centroids = now.copy()
        for c, n, *total in sums.collect():  # one row for each centroid at most
            centroids[c] = [t // n for t in total]
    final = held.mapInArrow(lambda batches: assigned(batches, centroids, dim), "vec_id long, cluster int, distance long")
    by = {r["cluster"]: r["inertia"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    about = [(c, x, sum(by.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in sorted(by.items())]
    clusters = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def scaled(df: DataFrame, dim: int = 64, scale: int = 256, column: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with each component x as floor(scale * x), x as double; other vectors go."""
    fine = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(F.col(column), lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return df.where(F.col(column).isNotNull() & (F.size(column) == dim) & fine).select(F.col("vec_id").cast("long"), v.alias("v"))


def op12_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters(scaled(table(spark, sf_dir, "embeddings")))


def _sql(rounds: int = 5, k: int = 40, dim: int = 64) -> str:
    """The rounds written one after another; sums are whole numbers far below 2 ** 53."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k})
)""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min({{'c': c, 'd': d}}, {{'d': d, 'c': c}}) AS best FROM (
    SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{n}
  ) GROUP BY r, vec_id, v
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS z FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (
      SELECT best.c AS c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{n}
    ) GROUP BY c, i
  ) GROUP BY c
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c AS c, coalesce(m{n}.z, c{n}.z) AS z FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = c{rounds}.c
"""


QUERIES["op12_ball_clusters"] = op12_ball_clusters
ORACLES["op12_ball_clusters"] = _sql()
