"""Token sequences: windows, averages, transition models, decoding and packing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import is_word_char
from spanloom.operators.running import in_ranges
from spanloom.operators.spans import align_together, encoded, tags

SMOOTHING, EPS = 0.1, 1e-12
CATEGORIES = ("word", "init", "middle", "fin")


def windows(tokens: DataFrame, max_length: int, stride: int, special: int = 2) -> DataFrame:
    """``(doc_id, win, first, last)``: token ranges of overlapping windows; neighbours share ``stride`` tokens."""
    content = max_length - special
    if content < 1 or not 0 <= stride < content:
        raise ValueError(f"stride must be between 0 and {content - 1}")
    step = content - stride
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    last = F.greatest(F.ceil((F.col("n") - content) / step), F.lit(0)).cast("int")
    each = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    first = (F.col("win") * step).cast("long")
    return each.select("doc_id", "win", first.alias("first"), F.least(first + content, F.col("n")).alias("last"))


def categories(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, category)``: where each token lies in its word.

    A document's tokens meet its text once, and the text is cut into characters once, so
    that the cost is linear in both.
    """
    per = tokens.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("tokens"))
    rows = per.join(docs.select("doc_id", "text"), "doc_id")

    def named(inside: Column) -> Column:
        def one(t: Column) -> Column:
            left = (t["start"] > 0) & F.coalesce(F.get(inside, (t["start"] - 1).cast("int")), F.lit(False))
            right = F.coalesce(F.get(inside, t["end"].cast("int")), F.lit(False))
            name = F.when(left & right, "middle").when(left, "fin").when(right, "init").otherwise("word")
            return F.struct(t["start"].alias("start"), t["end"].alias("end"), name.alias("category"))

        return F.transform("tokens", one)

    # a variable of an outer lambda holds the characters' kinds, which are then found once for a text
    kinds = F.transform(F.split("text", ""), is_word_char)
    out = F.element_at(F.transform(F.array(kinds), named), 1)
    return rows.select("doc_id", F.explode(out).alias("t")).select("doc_id", "t.start", "t.end", "t.category")


def category(before: Column, after: Column) -> Column:
    """Where a token lies in its word, from the characters before and behind it: no join with the text where these are known."""
    left, right = (F.coalesce(is_word_char(c), F.lit(False)) for c in (before, after))
    return F.when(left & right, "middle").when(left, "fin").when(right, "init").otherwise("word")


def average(probs: DataFrame) -> DataFrame:
    """Mean of ``probs(doc_id, start, end, tag, p)`` over all windows that show a token; special tokens go."""
    return probs.where("start <> end").groupBy("doc_id", "start", "end", "tag").agg(F.avg("p").alias("p"))


def transition_counts(tagged: DataFrame) -> DataFrame:
    """``(category, prev, cur, n)``; a document starts after ``O``."""
    prev = F.lag("tag", 1, "O").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    return tagged.withColumn("prev", prev).groupBy("category", "prev", F.col("tag").alias("cur")).agg(F.count("*").alias("n"))


def transition_counts_together(rows: DataFrame, scheme: str) -> DataFrame:
    """``transition_counts`` of tokens that carry spans and lie together by document (see ``spans.align_together``).

    A batch is aligned, tagged and counted in one pass; only its counts are shuffled.
    """

    def pairs(table: pa.Table, code: np.ndarray) -> pa.Table:
        tag, names = encoded(table, scheme)
        start, end = (table.column(c).to_numpy() for c in ("start", "end"))
        by = np.lexsort((end, start, code))
        kinds = table.column("category").combine_chunks().dictionary_encode()
        kind, cur, doc = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)[by], tag[by], code[by]
        prev = np.where(np.r_[True, doc[1:] != doc[:-1]][: len(by)], 0, np.r_[0, cur[:-1]][: len(by)])  # 0: O
        both, n = np.unique(((kind * (len(names) + 1)) + prev + 1) * (len(names) + 1) + cur + 1, return_counts=True)
        both, cur = np.divmod(both, len(names) + 1)
        kind, prev = np.divmod(both, len(names) + 1)
        tags = pa.array([None, *names], pa.string())
        return pa.table({"category": kinds.dictionary.take(pa.array(kind)), "prev": tags.take(pa.array(prev)), "cur": tags.take(pa.array(cur)), "n": n})

    got = align_together(rows, pairs, "category string, prev string, cur string, n long")
    return got.groupBy("category", "prev", "cur").agg(F.sum("n").alias("n"))


def log_transitions(counts: DataFrame, scheme: str, structural: bool = False, smoothing: float = SMOOTHING) -> DataFrame:
    """Dense ``(category, prev, cur, logp)``: smoothed rows; ``structural`` subtracts the log share of the tag itself."""
    spark = counts.sparkSession
    t = tags(scheme)
    grid = spark.createDataFrame([(c, a, b) for c in CATEGORIES for a in t for b in t], "category string, prev string, cur string")
    n = F.coalesce("n", F.lit(0)) + F.lit(smoothing)
    rows = F.broadcast(grid).join(counts, ["category", "prev", "cur"], "left").withColumn("c", n)  # a fixed number of tags
    row, column, every = (F.sum("c").over(Window.partitionBy(*k)) for k in (("category", "prev"), ("category", "cur"), ("category",)))
    logp = F.log(F.col("c") / row)
    if structural:
        logp = logp - F.log(column / every)
    return rows.select("category", "prev", "cur", logp.alias("logp"))


def argmax(p: Column) -> Column:
    """Place, from 0, of the first largest entry of an array."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def viterbi_path(p: np.ndarray, category: np.ndarray, log_t: np.ndarray) -> np.ndarray:
    """Best tags of one sequence that starts after tag 0; ties go to the lower tag.

    ``p`` is (step, tag), ``category`` (step,), ``log_t`` (category, previous, current).
    """
    if not len(p):
        return np.zeros(0, np.int64)
    emit = np.log(np.maximum(p, EPS))
    best, back = log_t[category[0], 0] + emit[0], []
    for e, c in zip(emit[1:], category[1:]):
        through = best[:, None] + log_t[c]
        back.append(through.argmax(0))
        best = through.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def viterbi_paths(p: np.ndarray, category: np.ndarray, cuts: np.ndarray, log_t: np.ndarray) -> np.ndarray:
    """``viterbi_path`` of many sequences, row ``cuts[k]`` up to ``cuts[k + 1]`` each: one step a position for all of them.

    The longest come first, so that those still running are always the first ones.
    """
    size = np.diff(cuts)
    by = np.argsort(-size, kind="stable")
    start, size = cuts[:-1][by], size[by]
    emit = np.log(np.maximum(p, EPS))
    on = len(size) - np.searchsorted(size[::-1], np.arange(int(size.max(initial=0))), "right")  # sequences with a row at each position
    best = np.zeros((len(size), log_t.shape[1]))
    back: list[np.ndarray] = []
    for k, n in enumerate(on.tolist()):
        rows = start[:n] + k
        if k:
            through = best[:n, :, None] + log_t[category[rows]]
            back.append(through.argmax(1).astype(np.int16))
            best[:n] = through.max(1) + emit[rows]
        else:
            best[:n] = log_t[category[rows], 0] + emit[rows]
    path = np.zeros(len(p), np.int64)
    tag = best.argmax(1)
    for k in range(len(on) - 1, -1, -1):
        n = int(on[k])
        if k + 1 < len(on):
            m = int(on[k + 1])
            tag[:m] = back[k][np.arange(m), tag[:m]]
        path[start[:n] + k] = tag[:n]
    return path


def document_tokens(windows: DataFrame) -> DataFrame:
    """``(doc_id, pos, start, end)``: the distinct tokens of a document's overlapping windows in order, special ones left out."""
    rows = windows.where("start < end").select("doc_id", "start", "end").distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end")) - 1)


def viterbi(tokens: DataFrame, log_t: np.ndarray, tag_names: list[str], in_order: bool = False) -> DataFrame:
    """``(doc_id, start, end, tag)`` from ``(doc_id, start, end, category int, probs array)``.

    Tokens are dealt by document and sorted, unless they lie together by document and ``in_order`` already;
    a batch holds many documents, and what a batch cuts off waits for the next.
    """

    def decoded(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
        probs, category = np.stack(pdf["probs"].to_numpy()), pdf["category"].to_numpy()
        path = viterbi_paths(probs, category, cuts, log_t)
        return pdf[["doc_id", "start", "end"]].assign(tag=np.array(tag_names, object)[path])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["doc_id"].to_numpy()
            last = int(np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])[-1])
            if held and (last or held[-1]["doc_id"].iloc[-1] != ids[0]):
                yield decoded(pd.concat([*held, batch.iloc[:last]]))
                held = []
            elif last:
                yield decoded(batch.iloc[:last])
            held.append(batch.iloc[last:] if last else batch)
        if held:
            yield decoded(pd.concat(held))

    dealt = tokens.select("doc_id", "start", "end", "category", "probs")
    if not in_order:
        dealt = dealt.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end")
    return dealt.mapInPandas(run, "doc_id long, start long, end long, tag string")


def empty_predictor(batch: pd.DataFrame) -> list[list[dict]]:
    """No spans for any record: what stands in where there is no model."""
    return [[] for _ in range(len(batch))]


def predicted(records: DataFrame, predictor: Callable[[pd.DataFrame], list[list[dict]]] = empty_predictor, key: str = "hash", batch: int = 1024) -> DataFrame:
    """``(key, entities)``: ``predictor`` takes a batch of records (key and text) and gives their spans in the same order."""
    schema = f"{key} {records.schema[key].dataType.simpleString()}, entities array<struct<label:string,start:int,end:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                got = predictor(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} answers for {len(part)} records")
                yield pd.DataFrame({key: part[key].to_numpy(), "entities": pd.Series(got, dtype=object).to_numpy()})

    return records.select(key, "text").mapInPandas(run, schema)


def transition_array(rows: DataFrame, scheme: str, weight: float = 1.0) -> np.ndarray:
    """The few log transitions as (category, previous, current), times ``weight``."""
    t = {x: k for k, x in enumerate(tags(scheme))}
    out = np.zeros((len(CATEGORIES), len(t), len(t)))
    for r in rows.collect():  # a fixed number of tags and categories
        out[CATEGORIES.index(r["category"]), t[r["prev"]], t[r["cur"]]] = r["logp"]
    return weight * out


def blocks(
    sizes: DataFrame, content: int, order: str = "seq", n: str = "n_tokens", buckets: int | None = None, carry: int = 0, whole: bool = False
) -> DataFrame:
    """``(seq, block, from, to)``: where each document's tokens lie when all are joined and cut every ``content``.

    Running offsets are sums within ranges of the order, of about equal numbers of rows, plus
    sums of the ranges before, so no task orders the whole table; without ``buckets``, a range
    has about a million rows.
    ``carry`` tokens of an earlier pass come first. ``whole`` drops the short block at the
    end, whose tokens are what the next pass carries.
    """
    count, all_tokens = sizes.agg(F.count("*"), F.sum(n)).first()
    rows = in_ranges(sizes.select(order, n), order, 1_000_000 if buckets is None else max(1, math.ceil(count / buckets))).withColumnRenamed("range", "bucket")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("bucket").agg(F.sum(n).alias("t")).withColumn("base", F.coalesce(F.sum("t").over(earlier), F.lit(0))).select("bucket", "base")
    inside = Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(base, "bucket")
    off = F.col("base") + F.col("at") + F.lit(carry)
    rows = rows.where(F.col(n) > 0).select(order, off.alias("off"), (off + F.col(n)).alias("stop"))
    each = rows.select(order, "off", "stop", F.explode(F.sequence(F.floor(F.col("off") / content), F.floor((F.col("stop") - 1) / content))).alias("block"))
    if whole:
        each = each.where(F.col("block") < (carry + (all_tokens or 0)) // content)
    return each.select(
        order, "block", (F.greatest(F.col("off"), F.col("block") * content) - F.col("off")).alias("from"),
        (F.least(F.col("stop"), (F.col("block") + 1) * content) - F.col("off")).alias("to"),
    )


def head_flags(tokens: DataFrame, word: str = "word_id", key: str = "doc_id", order: str = "pos") -> DataFrame:
    """``head``: 1 for the first token of a document or word."""
    before = F.lag(word).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return tokens.withColumn("head", F.when(first | ~before.eqNullSafe(F.col(word)), 1).otherwise(0))


def best_epochs(history: DataFrame, patience: int, key: str = "run") -> DataFrame:
    """``(run, best_epoch, best, stopped_at)``: the first strictly best epoch before patience runs out."""
    order = Window.partitionBy(key).orderBy("epoch")
    before = F.max("f1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("better", before.isNull() | (F.col("f1") > before))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("last", last).withColumn("wait", F.col("epoch") - F.col("last"))
    stop = F.min(F.when(F.col("wait") >= patience, F.col("epoch"))).over(Window.partitionBy(key))
    rows = rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("epoch") <= F.col("stop")))
    return rows.groupBy(key).agg(F.max("last").alias("best_epoch"), F.max("f1").alias("best"), F.max("epoch").alias("stopped_at"))
