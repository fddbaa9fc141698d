"""Exact top-k search: exhaustive term-at-a-time accumulation over an inverted index.

A vector's non-zero components are its terms. Candidates are dealt into blocks of rows
and queries into blocks of queries; each cell of the two holds a bounded number of both
on one task. There the candidates' postings lie term after term, and each term of the
sparse query rows scatters its weighted postings into the queries' dense score arrays.
A partition selects the k highest of an array, and the cells' lists merge into one.

The queries grow with the table, so they are not broadcast: both sides are dealt out to
the cells by key. A candidate's block comes from its id and its place among the rows, and equal
query rows are searched once, so no id gathers rows.
Each row goes to as many cells as the other side has blocks: a search of all rows reads
candidates times query blocks, so query blocks are as large as a task's memory allows,
and vectors travel in the narrowest whole numbers that hold them all.

Defined results: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without an id; an empty vector scores zero with all; vectors of any
length are taken whole, and shorter ones lack the further terms. Rows with the query's own
id are its own row and are left out. Repeated rows of another id are candidates one by one;
rows that repeat a query id are one query, whose list ranks what each of them finds, so that
a candidate stands in it once for each (equal rows are searched once, and up to ``k`` copies listed). Ties go to the smaller id. Components saturate at
the bounds of a long; scores are exact, and those beyond a long are given as its bound, in
the order of their doubles. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import table
from spanloom.llm.registry import ORACLES, QUERIES


def postings(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Term to the rows that hold it and their weights."""
    by = np.argsort(terms, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(terms[by]) != 0, True]) if len(terms) else np.zeros(1, int)
    return {int(terms[by[s]]): (rows[by[s:e]], weights[by[s:e]]) for s, e in zip(cuts[:-1], cuts[1:])}


def dense(index: dict[int, tuple[np.ndarray, np.ndarray]], n: int, share: float = 0.25) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """The postings with a weight for every one of ``n`` rows, zero or not, where more than ``share`` of them hold the term."""
    out: dict[int, tuple[np.ndarray | slice, np.ndarray]] = {}
    for term, (rows, weights) in index.items():
        out[term] = rows, weights
        if len(rows) > share * n:
            full = np.zeros(n, weights.dtype)
            full[rows] = weights
            out[term] = slice(None), full
    return out


def accumulate(query: list[tuple[int, int]], index: dict[int, tuple[np.ndarray | slice, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    """Fill the dense ``scores`` of all candidates for one query of (term, weight) pairs."""
    scores[:] = 0
    for term, weight in query:
        if term in index:
            rows, weights = index[term]
            scores[rows] += weights * (weight if scores.dtype == object else scores.dtype.type(weight))
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first; ``ids`` ascend."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        above = np.flatnonzero(scores > least)
        place = np.r_[above, np.flatnonzero(scores == least)[: k - len(above)]]
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))]


def _sparse(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in vectors], np.int64)
    flat = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if len(sizes) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full = flat != 0
    return rows[full], terms[full], flat[full]


def exact_type(left: np.ndarray, right: np.ndarray, terms: int) -> type:
    """The narrowest number type that holds every sum of ``terms`` products, and its parts."""
    high = [max((abs(int(x)) for x in (w.min(initial=0), w.max(initial=0))), default=0) for w in (left, right)]
    bound = max(high[0], 1) * max(high[1], 1) * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def search_cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best candidates within one cell; both frames hold ``vec_id, v``, that of queries how often the row is there."""
    candidates = candidates.sort_values("vec_id", kind="stable")
    ids = candidates["vec_id"].to_numpy()
    held, held_terms, held_weights = _sparse(candidates["v"])
    who, terms, weights = _sparse(queries["v"])
    kind = exact_type(weights, held_weights, min(max(map(len, queries["v"]), default=0), max(map(len, candidates["v"]), default=0)))
    index = dense(postings(held, held_terms, held_weights.astype(kind)), len(ids))
    ends = np.searchsorted(who, np.arange(len(queries) + 1))
    scores, big = np.zeros(len(ids), kind), np.iinfo(np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    times = queries["times"].to_numpy() if "times" in queries else np.ones(len(queries), np.int32)
    for q, query_id in enumerate(queries["vec_id"].to_numpy()):
        own = slice(ends[q], ends[q + 1])
        accumulate(list(zip(terms[own].tolist(), weights[own].tolist())), index, scores)
        lo, hi = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
        place = np.sort(np.concatenate([select(scores[:lo], ids[:lo], k), hi + select(scores[hi:], ids[hi:], k)]))
        place = place[select(scores[place], ids[place], k)]
        found.append((np.full(len(place), query_id), ids[place], scores[place], np.full(len(place), times[q], np.int32)))
    if not found:
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "over": np.zeros(0, np.float64), "times": np.zeros(0, np.int32)})
    query, vec, score, times = (np.concatenate(x) for x in zip(*found))
    over = np.zeros(len(score))
    if kind is object:  # what a long cannot hold, for the order only
        over = np.array([float(s) if not big.min <= s <= big.max else 0.0 for s in score])
        score = np.array([min(max(s, big.min), big.max) for s in score], np.int64)
    return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score.astype(np.int64), "over": over, "times": times})


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, query_rows: int = 16_384, candidate_rows: int = 16_384
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``vectors`` holds ``vec_id`` and whole numbers ``v``."""
    widest = F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -1 - c))))  # that of the least long is a long
    n, nq, high = vectors.agg(F.count("*"), F.count_if(is_query), widest).first()
    blocks, query_blocks = 1 + n // candidate_rows, 1 + nq // query_rows
    narrow = next(t for t, top in (("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 64)) if (high or 0) < top)

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # both sides name a cell by two longs: the join of groups compares hashes of the keys as they are
    own = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks).cast("long"))
    query_own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(query_blocks).cast("long"))
    v = F.col("v").cast(f"array<{narrow}>").alias("v")
    right = vectors.select("vec_id", v, own.alias("c"), numbers(query_blocks).alias("q"))
    asked = vectors.where(is_query).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    left = asked.select("vec_id", v, "times", numbers(blocks).alias("c"), query_own.alias("q"))
    each = left.groupBy("c", "q").cogroup(right.groupBy("c", "q"))
    found = each.applyInPandas(lambda a, b: search_cell(a, b, k), "query_id long, vec_id long, score long, over double, times int")
    found = found.select("*", F.explode(F.sequence(F.lit(1), "times")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(df: DataFrame, column: str = "embedding", scale: int = 64) -> DataFrame:
    """``(vec_id, v)`` with each component x as floor(scale * x), x as double; invalid vectors go."""
    x = F.col(column)
    infinite = float("inf")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    return df.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long"), v.alias("v"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


QUERIES["op4_exact_topk"] = op4_exact_topk
ORACLES["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
