"""Combining runs: votes over spans, and weighted probabilities across token grids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.metrics import KEY, by_run, with_ratios
from spanloom.operators.spans import LABELS, PREFIXES, overlapped, swept, tags, together, without_overlaps


def majority(runs: int) -> int:
    return runs // 2 + 1


def votes(runs: DataFrame) -> DataFrame:
    """``(doc_id, label, start, end, n)``: runs that predict each span."""
    return runs.groupBy(*KEY).agg(F.countDistinct("run").alias("n"))


def elected(tally: DataFrame, threshold: int, prefer_votes: bool = True) -> DataFrame:
    """Spans with ``threshold`` votes, without overlaps: more votes first and then longer ones, or the other way round."""
    rows = tally.where(F.col("n") >= threshold)
    one = F.collect_list(F.struct("label", "start", "end", F.col("n").cast("long").alias("n")))
    chosen = without_overlaps(F.col("spans"), *([lambda s: s["n"]] if prefer_votes else [None, lambda s: s["n"]]))
    kept = rows.groupBy("doc_id").agg(one.alias("spans")).select("doc_id", F.explode(chosen).alias("s"))
    return kept.select("doc_id", "s.label", "s.start", "s.end")


def sweep(gold: DataFrame, tally: DataFrame, runs: int) -> DataFrame:
    """Counts and ratios of every threshold from 1 to ``runs``, before overlaps are settled, in one aggregation."""
    g = gold.select(*KEY).distinct().withColumn("g", F.lit(1))
    rows = tally.join(g, KEY, "full_outer").select(F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("g", F.lit(0)) == 1).alias("in_gold"))
    few = rows.groupBy("n", "in_gold").count()
    each = few.select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("threshold"))
    p, c = F.col("n") >= F.col("threshold"), F.col("count")
    some = lambda cond: F.sum(F.when(cond, c).otherwise(0))
    return with_ratios(
        each.groupBy("threshold").agg(some(p & F.col("in_gold")).alias("tp"), some(p & ~F.col("in_gold")).alias("fp"), some(~p & F.col("in_gold")).alias("fn"))
    )


def best(rows: DataFrame, by: str = "f1", order: str = "threshold") -> DataFrame:
    """The first row with the highest value."""
    return rows.orderBy(F.desc(by), order).limit(1)


#: what a prefix says of its token: 0 the first of a span, 1 a further one
ROLE = {"B": 0, "U": 0, "I": 1, "L": 1}


def projection(source: str, target: str) -> dict[str, str]:
    """Tag of ``source`` to its tag of ``target``: prefixes that ``target`` lacks go to its prefix of the same role."""
    have = PREFIXES[target]
    to = {p: p if p in have else next(x for x in have if ROLE[x] == ROLE[p]) for p in PREFIXES[source]}
    if set(to.values()) != set(have):
        raise ValueError(f"{source} does not fill the prefixes of {target}")
    return dict(zip(tags(source), ["O", *(f"{to[p]}-{label}" for label in LABELS for p in PREFIXES[source])]))


def projected(probs: DataFrame, source: str, target: str, *keys: str) -> DataFrame:
    """Probabilities summed into the tags of the coarser scheme."""
    cases = F.create_map(*[F.lit(x) for pair in projection(source, target).items() for x in pair])
    return probs.groupBy(*keys, cases[F.col("tag")].alias("tag")).agg(F.sum("p").alias("p"))


def onto_grid(grid: DataFrame, probs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, tag, total, weight)``: overlap-weighted sums of another grid's probabilities.

    A sweep over each document: only what overlaps is looked at.
    """

    def summed(grid: pa.Table, probs: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.Table:
        start, end, s, e = (t.column(c).to_numpy() for t in (grid, probs) for c in ("start", "end"))
        order, low, high = overlapped(a, start, end, b, s, e)
        n = high - low
        mine = np.repeat(np.arange(len(a)), n)
        other = order[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)] if n.sum() else np.zeros(0, np.int64)
        keep = e[other] > start[mine]
        mine, other = mine[keep], other[keep]
        weight = np.minimum(e[other], end[mine]) - np.maximum(s[other], start[mine])
        tag = probs.column("tag").combine_chunks().dictionary_encode()
        codes = tag.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by = np.lexsort((codes[other], end[mine], start[mine], a[mine]))
        mine, other, weight = mine[by], other[by], weight[by]
        if not len(by):
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", grid.column("doc_id").type), ("start", pa.int64()), ("end", pa.int64()), ("tag", pa.string()), ("total", pa.float64()), ("weight", pa.int64()))})
        cell = np.stack([a[mine], start[mine], end[mine], codes[other]])
        first = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(0)])
        return pa.table(
            {
                "doc_id": grid.column("doc_id").take(pa.array(mine[first])), "start": cell[1, first], "end": cell[2, first], "tag": tag.dictionary.take(pa.array(cell[3, first])),
                "total": np.add.reduceat(probs.column("p").to_numpy()[other] * weight, first), "weight": np.add.reduceat(weight, first),
            }
        )

    long = lambda df, *more: df.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *more)
    fine = probs.where("start is not null and end is not null and tag is not null and p is not null")
    schema = f"doc_id {dict(grid.dtypes)['doc_id']}, start long, end long, tag string, total double, weight long"
    return swept(long(grid), long(fine, "tag", F.col("p").cast("double").alias("p")), summed, schema)


def onto_grid_together(rows: DataFrame) -> DataFrame:
    """``onto_grid`` of rows that lie together by document and carry a cell (``start``, ``end``) and another grid's (``s``, ``e``, ``ps``).

    ``ps`` are the probabilities of a few tags, in a fixed order. Further columns stay, and instead of ``s``, ``e`` and ``ps`` a row has
    ``totals``, an array in the same order, and ``weight``: the overlap-weighted sums over its document.
    """

    def summed(table: pa.Table, code: np.ndarray) -> pa.Table:
        own = np.flatnonzero(pc.and_(table.column("s").is_valid(), table.column("ps").is_valid()).to_numpy() & (code >= 0))
        start, end = (table.column(c).to_numpy() for c in ("start", "end"))
        s, e = (table.column(c).take(pa.array(own)).to_numpy() for c in ("s", "e"))
        ps = table.column("ps").take(pa.array(own)).combine_chunks()
        p = pc.list_flatten(ps).to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 1))
        order, low, high = overlapped(np.where(code < 0, code.max(initial=0) + 1, code), start, end, code[own], s, e)
        n = high - low
        mine = np.repeat(np.arange(len(n)), n)
        other = order[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)] if n.sum() else np.zeros(0, np.int64)
        keep = e[other] > start[mine]
        mine, other = mine[keep], other[keep]
        weight = np.minimum(e[other], end[mine]) - np.maximum(s[other], start[mine])
        total, weights = np.zeros((len(n), p.shape[1])), np.zeros(len(n), np.int64)
        np.add.at(total, mine, p[other] * weight[:, None])
        np.add.at(weights, mine, weight)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(total.ravel()))
        return table.drop_columns(["s", "e", "ps"]).append_column("totals", lists).append_column("weight", pa.array(weights))

    kept = [(c, t) for c, t in rows.dtypes if c not in ("s", "e", "ps")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept), "totals array<double>, weight long"])
    long = [F.col(c).cast("long").alias(c) for c in ("s", "e")]
    return together(rows.select(*[c for c, _ in kept], *long, "ps"), summed, schema)


def blended(models: dict[str, tuple[Column, Column]], weights: dict, n_tags: int) -> Column:
    """``blend`` in the row: an array of the tags' weighted means from each model's ``(totals, weight)``; 0 where nothing weighs."""
    add = lambda parts: reduce(lambda x, y: x + y, parts)
    weight = add([F.lit(float(weights[m])) * w for m, (_, w) in models.items()])
    p = lambda k: add([F.lit(float(weights[m])) * F.get(t, F.lit(k)) for m, (t, _) in models.items()])
    return F.array(*[F.when(weight > 0, p(k) / weight).otherwise(0.0) for k in range(n_tags)])


def blend(parts: DataFrame, weights: dict) -> DataFrame:
    """``(doc_id, start, end, tag, p)``: weighted mean of ``parts`` with a ``model`` column; 0 where nothing weighs."""
    w = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("model")]
    total, weight = F.sum(w * F.col("total")), F.sum(w * F.col("weight"))
    return parts.groupBy("doc_id", "start", "end", "tag").agg(F.when(weight > 0, total / weight).otherwise(0.0).alias("p"))


def top_tag(probs: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """The likeliest tag of each token; ties go to the tag named first."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag"))
    best_tag = F.max_by("tag", F.struct(F.col("p"), -place))
    return probs.groupBy(*keys, "doc_id", "start", "end").agg(best_tag.alias("tag"))


def coarsest(models: DataFrame, *keys: str) -> DataFrame:
    """``bio`` if any model (of the keys) uses it, else ``bilou``."""
    return models.groupBy(*keys).agg(F.when(F.bool_or(F.col("scheme") == "bio"), "bio").otherwise("bilou").alias("scheme"))


def blend_all(parts: DataFrame, trials: list[dict]) -> DataFrame:
    """``blend`` under every one of a few weightings in one job; ``trial`` is its place in the list."""
    table = F.array(*[F.create_map(*[F.lit(x) for k, v in t.items() for x in (k, float(v))]) for t in trials])
    each = parts.select("*", F.posexplode(table).alias("trial", "weights"))
    w = F.element_at("weights", F.col("model"))
    total, weight = F.sum(w * F.col("total")), F.sum(w * F.col("weight"))
    return each.groupBy("trial", "doc_id", "start", "end", "tag").agg(F.when(weight > 0, total / weight).otherwise(0.0).alias("p"))


def weight_search(
    score: Callable[[dict], float] | None, models: list, values=(0, 0.5, 1, 2, 3, 4), passes: int = 2, least: float = 1e-6,
    score_all: Callable[[list[dict]], list[float]] | None = None,
) -> tuple[dict, float]:
    """Coordinate search over model weights from all ones, a weight at a time with all of its values.

    ``score_all`` scores a list of weightings in one job; ``score`` does one at a time. A value
    is taken if it beats the best so far by ``least``; a pass without any ends the search.
    """
    many = score_all or (lambda trials: [score(t) for t in trials])

    def improve(state: tuple[dict, float], model) -> tuple[dict, float]:
        trials = [t for t in ({**state[0], model: float(v)} for v in values) if any(t.values())]
        return reduce(lambda best, got: got if got[1] > best[1] + least else best, zip(trials, many(trials)), state)

    start = dict.fromkeys(models, 1.0)
    state = start, many([start])[0]
    for _ in range(passes):
        before, state = state, reduce(improve, models, state)
        if state == before:
            break
    return state


def run_scores(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Micro counts and ratios of each run, best first, ties by name."""
    out = with_ratios(by_run(gold, runs))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "run")))
