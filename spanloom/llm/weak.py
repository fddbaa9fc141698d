"""Quality classifier: weak labels from overlapping heuristics, and a hashed linear scorer.

Heuristic labellers each vote good, bad or nothing on a text. Votes of all texts are
counted by pattern; there are at most 3 ** (number of labellers) patterns, so the counts
fit the driver at every size, and expectation-maximisation over them is that over all
texts. It estimates the share of good texts and each labeller's accuracy on both classes;
the posterior of a text's pattern is its weak label.

A logistic scorer over hashed words and word shapes is then fitted to the posterior
labels of a bounded sample of distinct texts, chosen by a hash of the text, and scores every
whole text. A text counts once in the sample, with the logarithm of its copies as weight,
and every pattern that a thousandth of the rows have is in it; so junk that repeats is learned as such,
and does not drown what is rare.

Defined results: null and empty texts have no words, are voted on as such and scored by
the bias alone; texts of any length are measured and scored whole; repeated rows get equal
scores; a score equal to the threshold is kept, and a value equal to a labeller's limit has
its vote; an empty table gives no rows; where all posteriors agree the scorer learns that
constant, be it from a single text; ids may be null or repeat, and play no part in the sample;
further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import SLICE_BYTES, STAGE_BYTES, byte_class, codes, counts, cut, keep_rows, map_slices, split_words, table, text_bytes
from spanloom.llm.registry import QUERIES
from spanloom.llm.xxh import xxh64

BITS = 15
#: hashed words, hashed shapes, and words like the one before
COLUMNS = (2 << BITS) + 1
GOOD, BAD, NONE = 2, 1, 0

#: Labellers: a measure, the side that is better, the value from which it votes good (None: it
#: never does), and that from which it votes bad. They overlap on purpose: a kind of junk shows
#: in several measures at once. Most only object, since junk of one kind looks fine to the others.
LABELLERS: tuple[tuple[str, str, float | None, float], ...] = (
    ("words", "high", 80, 12),
    ("symbols per word", "low", None, 0.15),
    ("words that end in a symbol", "low", None, 0.2),
    ("capitals per letter", "low", None, 0.5),
    ("exclamation marks per word", "low", None, 0.3),
    ("share of the commonest word", "low", 0.15, 0.3),
    ("distinct words per word", "high", None, 0.12),
    ("share of repeated lines", "low", None, 0.4),
    ("words without a letter", "low", None, 0.25),
    ("words like the one before", "low", None, 0.3),
    ("word pairs seen before", "low", None, 0.65),
)


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


UPPER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
ENDS = b"#*$%&|<>!=+~^_@"
SYMBOLS = b"#*$%&|<>=+~^_\\{}[]"


class Words:
    """Words of a slice of texts: rows, codes, distinct words, and their bytes."""

    def __init__(self, texts: pa.Array) -> None:
        self.texts, self.n = texts, len(texts)
        self.rows, words = split_words(texts)
        self.code, self.kinds = codes(words)
        self.raw, self.at = text_bytes(self.kinds)
        same = (self.rows[1:] == self.rows[:-1]) & (self.code[1:] == self.code[:-1])
        self.again = np.r_[np.zeros(min(len(self.rows), 1), bool), same]

    def per_kind(self, wanted: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(wanted[self.raw], out=total[1:])
        return np.diff(total[self.at])


def measures(w: Words) -> np.ndarray:
    """One column for each labeller, in their order."""
    n = w.n
    words = counts(w.rows, n)
    some = np.maximum(words, 1)
    letters = np.maximum(byte_class(w.texts, bytes(np.flatnonzero(LETTER).tolist())), 1)
    last = np.zeros(len(w.kinds), bool)
    if len(w.kinds):
        last = _table(ENDS)[w.raw[w.at[1:] - 1]]
    bare = w.per_kind(LETTER) == 0
    pair, times = np.unique(w.rows * max(len(w.kinds), 1) + w.code, return_counts=True)
    pair_row = pair // max(len(w.kinds), 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, pair_row, times)
    kinds = max(len(w.kinds), 1)
    two = np.flatnonzero(w.rows[1:] == w.rows[:-1])
    n_pairs = counts(w.rows[two], n)
    following = np.unique(w.code[two] * kinds + w.code[two + 1], return_inverse=True)[1]
    fresh_pairs = counts(np.unique(w.rows[two] * (len(two) + 1) + following) // (len(two) + 1), n)
    lines = pc.split_pattern(pc.fill_null(w.texts, ""), "\n")
    line_rows, line = pc.list_parent_indices(lines), lines.flatten()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0)
    line_rows = pc.filter(line_rows, full).to_numpy().astype(np.int64)
    line_code, line_kinds = codes(pc.filter(line, full))
    n_lines = counts(line_rows, n)
    fresh = counts(np.unique(line_rows * max(len(line_kinds), 1) + line_code) // max(len(line_kinds), 1), n)
    return np.stack(
        [
            words,
            byte_class(w.texts, SYMBOLS) / some,
            counts(w.rows, n, last[w.code]) / some,
            byte_class(w.texts, bytes(np.flatnonzero(UPPER).tolist())) / letters,
            byte_class(w.texts, b"!") / some,
            np.where(words >= 20, top / some, 0),
            np.where(words >= 20, counts(pair_row, n) / some / np.minimum(1, (60 / some) ** 0.5), 1),
            (n_lines - fresh) / np.maximum(n_lines, 1),
            counts(w.rows, n, bare[w.code]) / some,
            counts(w.rows, n, w.again) / some,
            (n_pairs - fresh_pairs) / np.maximum(n_pairs, 1),
        ],
        axis=1,
    )


def vote(values: np.ndarray) -> np.ndarray:
    """Pattern of each text: its votes as a number in base three, the first labeller lowest."""
    pattern = np.zeros(len(values), np.int64)
    for k, (_, better, good, bad) in enumerate(LABELLERS):
        x = values[:, k]
        sign = 1 if better == "high" else -1
        v = np.where(sign * x <= sign * bad, BAD, NONE)
        if good is not None:
            v = np.where(sign * x >= sign * good, GOOD, v)
        pattern += v * 3**k
    return pattern


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class WeakModel:
    """``share`` of good texts, and the chance of each vote given bad (0) and good (1)."""

    share: float
    chance: np.ndarray  # labeller, class, vote

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability that a text with this pattern is good."""
        votes = votes_of(pattern)
        log = np.log(np.array([1 - self.share, self.share]))[None, :].repeat(len(votes), 0)
        for k in range(votes.shape[1]):
            log += np.log(self.chance[k][:, votes[:, k]] + 1e-12).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def estimate(pattern: np.ndarray, weight: np.ndarray, rounds: int = 100, prior: float = 0.002, most_false: float = 0.03) -> WeakModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from labellers that are right more often than not, and a small share
    ``prior`` of such votes stays in each estimate, so that the classes cannot change places.
    A labeller is taken to object to a share ``most_false`` of the good texts at most, or a
    kind of junk that two labellers see could pass for a kind of good text.
    """
    votes = votes_of(pattern)
    # votes none, bad, good; rows bad and good
    objects, both = np.array([[0.6, 0.4, 0], [0.98, 0.02, 0]]), np.array([[0.3, 0.4, 0.3], [0.23, 0.02, 0.75]])
    seed = np.array([objects if good is None else both for _, _, good, _ in LABELLERS])
    model = WeakModel(0.85, seed)
    total = weight.sum()
    for _ in range(rounds if total else 0):
        good = model.posterior(pattern)
        by_class = np.stack([(1 - good) * weight, good * weight])
        chance = np.empty_like(model.chance)
        for k in range(votes.shape[1]):
            for v in range(3):
                chance[k, :, v] = by_class[:, votes[:, k] == v].sum(1)
        chance += (1 + prior * total) * seed
        chance /= chance.sum(2, keepdims=True)
        false = chance[:, 1, BAD]
        rest = (1 - np.minimum(false, most_false)) / np.maximum(1 - false, 1e-12)
        chance[:, 1, [NONE, GOOD]] *= rest[:, None]
        chance[:, 1, BAD] = np.minimum(false, most_false)
        share = float((by_class[1].sum() + 0.85) / (total + 1))
        done = np.abs(chance - model.chance).max() < 1e-7
        model = WeakModel(share, chance)
        if done:
            break
    return model


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashed features of each distinct word: its lower-cased spelling, and its shape.

    The shape keeps symbols, writes A, a and 9 for the kinds of letters and digits, and
    folds runs.
    """
    if not len(w.kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.uint64((1 << BITS) - 1)
    raw, at = text_bytes(pc.ascii_lower(w.kinds))
    word = xxh64(raw, at[:-1], np.diff(at), 1) & mask
    shape = np.arange(256, dtype=np.uint8)
    shape[LETTER] = ord("a")
    shape[UPPER] = ord("A")
    shape[48:58] = ord("9")
    raw = shape[w.raw]
    head = np.zeros(len(raw) + 1, bool)
    head[w.at] = True
    keep = head[:-1] | np.r_[True, raw[1:] != raw[:-1]]
    kept = np.r_[0, np.cumsum(keep)]
    return word.astype(np.int64), (xxh64(raw[keep], kept[w.at[:-1]], np.diff(kept[w.at]), 2) & mask).astype(np.int64)


def linear(w: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores between 0 and 1: mean weight of a text's words, shapes and doubled words, plus the bias."""
    word, shape = buckets(w)
    own = weights[word] + weights[(1 << BITS) + shape]
    total = np.bincount(w.rows, weights=own[w.code] + w.again * weights[-1], minlength=w.n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(counts(w.rows, w.n), 1) + bias, -700, 700)))


def fit_linear(
    rows: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, epochs: int = 60, rate: float = 0.3, decay: float = 1e-5
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse weighted rows with soft targets, by full-batch Adam."""
    n, size = len(target), COLUMNS
    share = np.full(n, 1 / max(n, 1)) if weight is None else weight / max(weight.sum(), 1e-12)
    weights, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(rows, weights=value * weights[column], minlength=n) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - target) * share
        g = np.r_[np.bincount(column, weights=value * d[rows], minlength=size) + decay * weights, d.sum()]
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-5)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, float(bias)


@dataclass
class QualityModel:
    weak: WeakModel
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, sample: int = 4000, frequent: int = 1000, seed: int = 17, limit: int = SLICE_BYTES) -> QualityModel:
    """EM over the votes of all texts; the scorer from ``sample`` distinct texts, or all if there are fewer.

    The sample has the lowest hashes of distinct texts, and the lowest one of each pattern that
    at least one in ``frequent`` rows has (so ``frequent`` texts more at most), whatever the
    order of rows. Only pattern counts, the chosen hashes and their sparse features reach the driver.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("hash"))

    def votes(part: pa.RecordBatch) -> dict:
        return {"pattern": vote(measures(Words(part.column("text")))), "hash": part.column("hash")}

    kinds = map_slices(hashed, ["text", "hash"], votes, "pattern long, hash long", limit=limit).groupBy("pattern", "hash").agg(F.count("*").alias("n"))
    kinds = cut(kinds.withColumn("place", F.xxhash64("hash", F.lit(seed))))
    own = F.struct("place", "hash", "n").alias("own")
    got = kinds.groupBy("pattern").agg(F.sum("n").alias("count"), F.min(own).alias("own")).toPandas()
    weak = estimate(got["pattern"].to_numpy(np.int64), got["count"].to_numpy(np.float64))
    total = int(got["count"].sum())
    chosen = {r["hash"]: r["n"] for r in kinds.orderBy("place", "hash", "pattern").limit(sample).select("hash", "n").collect()}
    chosen |= {own["hash"]: own["n"] for own, n in zip(got["own"], got["count"]) if n * frequent >= total}

    def features(part: pa.RecordBatch) -> dict:
        w = Words(part.column("text"))
        word, shape = buckets(w)
        base = w.rows * COLUMNS
        key, value = np.unique(np.r_[base + word[w.code], base + (1 << BITS) + shape[w.code], base[w.again] + COLUMNS - 1], return_counts=True)
        ends = np.searchsorted(key, np.arange(w.n + 1) * COLUMNS)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key % COLUMNS).astype(np.int32)))
        times = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.astype(np.int32)))
        return {"hash": part.column("hash"), "pattern": vote(measures(w)), "n": counts(w.rows, w.n), "at": lists, "times": times}

    keys = docs.sparkSession.createDataFrame([(h,) for h in chosen], "hash long")
    alone = hashed.join(F.broadcast(keys), "hash", "left_semi")
    rows = map_slices(alone, ["text", "hash"], features, "hash long, pattern long, n long, at array<int>, times array<int>", limit=limit)
    first = rows.groupBy("hash").agg(*[F.first(c).alias(c) for c in ("pattern", "n", "at", "times")]).toPandas()  # equal texts, equal features
    first = first.sort_values("hash", ignore_index=True)
    sizes = np.array([len(x) for x in first["at"]], np.int64)
    row = np.repeat(np.arange(len(first)), sizes)
    column = np.concatenate([*first["at"], np.zeros(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*first["times"], np.zeros(0, np.int32)]) / np.maximum(first["n"].to_numpy(np.float64), 1)[row]
    weight = np.log2(1 + np.array([chosen[h] for h in first["hash"]], np.float64))
    weights, bias = fit_linear(row, column, value, weak.posterior(first["pattern"].to_numpy(np.int64)), weight)
    return QualityModel(weak, weights, bias)


SCHEMA = "doc_id long, pattern long, weak_label double, score double, kept boolean"


def quality_classifier(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Votes, weak label, score and verdict (``score >= threshold``) of every text."""

    def f(part: pa.RecordBatch) -> dict:
        w = Words(part.column("text"))
        pattern = vote(measures(w))
        score = linear(w, model.weights, model.bias)
        return {"doc_id": part.column("doc_id"), "pattern": pattern, "weak_label": model.weak.posterior(pattern), "score": score, "kept": score >= threshold}

    return map_slices(docs, ["doc_id", "text"], f, SCHEMA)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a classifier fitted to them keeps, with all of their columns."""
    model = fit(docs, limit=STAGE_BYTES)
    return keep_rows(docs, lambda texts: linear(Words(texts), model.weights, model.bias) >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier(docs, fit(docs))


QUERIES["op9_quality_classifier"] = op9_quality_classifier
